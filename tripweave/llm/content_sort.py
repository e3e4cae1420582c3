"""Exact deduplication by sorting contents.

Normalised texts are range-partitioned by sampled splitters and sorted
externally, so that equal texts stand next to each other; comparing whole
neighbours finds the groups. A text that the sample shows to be frequent is
split over several sort keys, so that no group of copies lands in one task,
and the parts' few summaries are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WHITE, numbered, partitions, stored, text_of

#: Rows, about, that the search for frequent texts looks at.
SAMPLE_ROWS = 20_000
#: A text that the sample holds so often is split, into parts of so many sampled rows.
FREQUENT = 8
#: Code points of a text by which it is ordered first.
PREFIX = 16


def normalised(text: str = "text"):
    """The text without white space; null counts as empty."""
    return F.translate(text_of(text), WHITE, "")


def frequent_texts(rows: DataFrame, total: int) -> DataFrame:
    """One row for each text frequent in the sample: its hash and the parts to split it into.

    Rows are drawn one by one, whatever their ids and texts. At most SAMPLE_ROWS / FREQUENT rows, about, so it can be broadcast.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    found = rows.sample(share, 7).groupBy("norm_hash").count().filter(F.col("count") >= FREQUENT).collect()
    schema = T.StructType([T.StructField("norm_hash", T.LongType()), T.StructField("parts", T.IntegerType())])
    return rows.sparkSession.createDataFrame([(r[0], -(-r[1] // FREQUENT)) for r in found], schema)


def content_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row (its number), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; null counts as
    empty. Of a group the row with most code points in its original text stays,
    then the one with the smallest id (a null id comes last); of repeated rows
    with the same id exactly one is ``kept``. ``row`` names a column that
    numbers the rows; else they are numbered. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row"), F.col(doc_id).alias("doc_id"), F.length(text_of(text)).alias("n_chars"), normalised(text).alias("norm")).withColumn("norm_hash", F.xxhash64("norm"))
    frequent = F.broadcast(frequent_texts(rows.select("norm_hash"), docs.count()))
    keyed = (
        rows.join(frequent, "norm_hash", "left")
        # by the row's own number, so that rows with one id and text are split as well
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int"))
        .select("row", "doc_id", "n_chars", "norm", "norm_hash", F.substring("norm", 1, PREFIX).alias("prefix"), "part", F.col("parts").isNotNull().alias("split"))
    )
    best = (F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    # Splitters are sampled from a prefix and a hash, so that whole texts never travel to the driver.
    splitters = ("prefix", "norm_hash", "part")
    ordered = keyed.repartitionByRange(partitions(spark), *splitters).sortWithinPartitions(*splitters, "norm", *best)
    # The range partitioning and the order above serve this window: groups are runs of equal neighbours.
    whole = Window.partitionBy(*splitters, "norm")
    run = whole.orderBy(*best)
    runs = stored(
        ordered.select(
            "row", "doc_id", "n_chars", "split", "part",
            F.sha2("norm", 256).alias("text_sha256"),
            F.first("doc_id").over(run).alias("first_id"),
            F.row_number().over(run).alias("place"),
            F.count(F.lit(1)).over(whole).alias("run_size"),
        ),
        "content-runs",
    )
    # One row for each part of each frequent text: few, as the sample bounds them.
    merged = (
        runs.filter("split AND place = 1")
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("first_id").isNull().alias("n"), F.col("first_id").alias("i"), F.col("part").alias("p"))).alias("best"),
            F.sum("run_size").alias("total"),
        )
    )
    return runs.join(F.broadcast(merged), "text_sha256", "left").select(
        "row", "doc_id",
        F.when(F.col("split"), F.col("best.i")).otherwise(F.col("first_id")).alias("keep_id"),
        F.when(F.col("split"), F.col("total")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & (~F.col("split") | (F.col("part") == F.col("best.p")))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`content_groups` keeps, with all their columns: one of each group of equal texts.

    Rows are told apart by a number, so it does not matter whether ids are null
    or repeated. An empty table gives no rows.
    """
    rows, number = numbered(docs)
    staying = content_groups(rows, doc_id, text, number).filter("kept").select(F.col("row").alias(number))
    return rows.join(staying, number, "left_semi").select(*docs.columns)
