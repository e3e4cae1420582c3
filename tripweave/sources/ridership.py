"""The ridership table: CSV files in, a clustered Parquet table out; station reference tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import abbreviated
from ..functions.routes import route_set

#: Columns of the published extract, and what they are called here.
COLUMNS = {
    "Year": "year", "Month": "month", "Day of Week": "day_of_week", "Hour of Day": "hour",
    "Origin Station Complex ID": "origin_id", "Destination Station Complex ID": "dest_id", "Estimated Average Ridership": "ridership",
}
INTEGERS = ("year", "month", "hour", "origin_id", "dest_id")
RIDERSHIP = T.DecimalType(9, 4)


class IngestError(ValueError):
    """An input or an option that cannot be used."""


class Summary(NamedTuple):
    rows: int
    first_month: int | None
    last_month: int | None


def read_csv_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files of paths, folders and patterns as strings, columns matched by name.

    Files are grouped by their header: one read for each order of columns, then
    a union by name.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    reader = spark.read.option("header", True).option("escape", '"')
    for file in listed_files(spark, paths):
        by_header.setdefault(tuple(reader.csv(file).columns), []).append(file)
    if not by_header:
        raise IngestError(f"no input files: {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.csv(files) for files in by_header.values()])


def listed_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths, folders and patterns (``*``, ``?``, ``[]``, ``{}``) stand for, in any file system of Spark's; each once."""
    conf, found = spark._jsc.hadoopConfiguration(), {}
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        system = path.getFileSystem(conf)
        hits = list(system.globStatus(path) or [])
        if not hits:
            raise IngestError(f"no input files: {text}")
        for hit in hits:
            inside = system.listStatus(hit.getPath()) if hit.isDirectory() else [hit]
            found |= {f.getPath().toString(): None for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"}
    return sorted(found)


def number(column: Column) -> Column:
    """Text with thousands separators as something that can be cast."""
    return F.regexp_replace(F.trim(column), ",", "")


def ridership_value(value: Column, decimals: int | None = None) -> Column:
    """As DECIMAL(9,4), after rounding half away from zero if asked for."""
    exact = value.cast("decimal(20,10)")
    return (exact if decimals is None else F.round(exact, decimals)).cast(RIDERSHIP)


def normalised(raw: DataFrame, decimals: int | None = None) -> DataFrame:
    """Only the columns that are not functions of others, typed."""
    if decimals is not None and decimals < 0:
        raise IngestError("the number of decimals can't be negative")
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise IngestError(f"columns missing from the input: {missing}")
    typed = {new: number(F.col(f"`{old}`")).cast("int") if new in INTEGERS else F.col(f"`{old}`") for old, new in COLUMNS.items() if new != "ridership"}
    value = ridership_value(number(F.col("`Estimated Average Ridership`")), decimals)
    return raw.select(*[c.alias(n) for n, c in typed.items()], value.alias("ridership"))


def is_there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_ridership(df: DataFrame, path: str, force: bool = False, partitions: int | None = None) -> Summary | None:
    """Write the table sorted by station pair, so that readers skip row groups; leave an existing one unless forced.

    Returns its summary, which the write itself observes, or None if it was
    left. Bloom filters on the stations let readers skip row groups whose range
    holds an id that none of their rows has.
    """
    if not force and is_there(df.sparkSession, path):
        return None
    seen, month = Observation(), F.col("year") * 100 + F.col("month")
    order = ["origin_id", "dest_id", "day_of_week", "hour"]
    placed = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    (
        placed.sortWithinPartitions(*order)
        .observe(seen, F.count(F.lit(1)).alias("rows"), F.min(month).alias("first"), F.max(month).alias("last"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .option("parquet.writer.version", "v2")
        .option("parquet.bloom.filter.enabled#origin_id", "true")
        .option("parquet.bloom.filter.enabled#dest_id", "true")
        .parquet(path)
    )
    return Summary(*(seen.get[k] for k in ("rows", "first", "last")))


def summary(df: DataFrame) -> Summary:
    month = F.col("year") * 100 + F.col("month")
    return Summary(*df.agg(F.count(F.lit(1)), F.min(month), F.max(month)).first())


_STATION = "complex_id int, name string, routes array<string>, lat double, lon double, borough string, cbd boolean"


def read_complexes(spark: SparkSession, path: str) -> DataFrame:
    """One row a complex; of rows with the same id the last of the file counts.

    Station tables have a few hundred rows and stay in one partition, so that nothing about stations is ever shuffled.
    """
    raw = spark.read.option("header", True).csv(path).coalesce(1)
    rows = raw.select("*", F.monotonically_increasing_id().alias("place"))
    last = rows.groupBy(F.col("complex_id").cast("int").alias("complex_id")).agg(F.max_by(F.struct(*[c for c in raw.columns if c != "complex_id"]), "place").alias("s"))
    return last.select(
        "complex_id", abbreviated(F.col("s.stop_name")).alias("name"), route_set(F.col("s.daytime_routes")).alias("routes"),
        F.col("s.latitude").cast("double").alias("lat"), F.col("s.longitude").cast("double").alias("lon"), F.col("s.borough").alias("borough"),
        (F.col("s.cbd") == "true").alias("cbd"),
    )


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """One row a platform, numbered from 0 in the order of the file."""
    raw = spark.read.option("header", True).csv(path).coalesce(1)  # reference data: a few hundred lines
    return raw.select(
        F.monotonically_increasing_id().cast("int").alias("platform_id"), F.col("complex_id").cast("int").alias("complex_id"), abbreviated(F.col("stop_name")).alias("name"),
        F.col("line"), route_set(F.col("daytime_routes")).alias("routes"), F.col("gtfs_latitude").cast("double").alias("lat"),
        F.col("gtfs_longitude").cast("double").alias("lon"), F.col("borough"),
    )
