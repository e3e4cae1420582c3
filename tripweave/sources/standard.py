"""The ridership model over the standard tables: a view of suppliers, customers and line items as stations and trips.

Every supplier is a platform, every nation a complex. Which routes stop at a platform goes by its nation and line, and
at many there is none, so that complexes keep few routes however many suppliers there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routes import route_set

#: A nation's line has the letters at these places, multiples of nation and line within a cycle; past the last letter there is none.
LETTERS, CYCLES = "ABCDEFGH", ((3, 1, 16), (5, 2, 24))
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def platforms(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    n = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    letter = lambda a, b, n: F.substring(F.lit(LETTERS), ((F.col("s_nationkey") * a + key % 5 * b) % n + 1).cast("int"), F.lit(1))
    listed = F.array_join(F.array_remove(F.array(*[letter(*c) for c in CYCLES]), ""), " ")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.cast("int").alias("platform_id"), F.col("s_nationkey").alias("complex_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("L"), (key % 5).cast("string")).alias("line"), route_set(listed).alias("routes"),
        (F.lit(40.5) + (key * 41 % 100) * F.lit(0.004)).cast("double").alias("lat"), (F.lit(-74.2) + (key * 59 % 100) * F.lit(0.005)).cast("double").alias("lon"),
        F.col("r_name").alias("borough"),
    )


def complexes(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    routes = platforms(spark, folder).groupBy(F.col("complex_id").alias("c")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("routes")))).alias("routes"))
    key = F.col("n_nationkey")
    return n.join(F.broadcast(routes), key == F.col("c"), "left").select(
        key.alias("complex_id"), F.col("n_name").alias("name"), F.coalesce("routes", F.array().cast("array<string>")).alias("routes"),
        (F.lit(40.5) + (key * 37 % 100) * F.lit(0.004)).cast("double").alias("lat"), (F.lit(-74.2) + (key * 53 % 100) * F.lit(0.005)).cast("double").alias("lon"),
        F.col("r_name").alias("borough"), (key % 3 == 0).alias("cbd"),
    ).coalesce(1)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """year, month, day_of_week, hour, origin_id, dest_id, ridership."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.dayofweek("l_shipdate"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), day.alias("day_of_week"), F.col("l_linenumber").alias("hour"),
            F.col("s_nationkey").alias("origin_id"), F.col("c_nationkey").alias("dest_id"), F.col("l_quantity").cast("decimal(9,4)").alias("ridership"),
        )
    )
