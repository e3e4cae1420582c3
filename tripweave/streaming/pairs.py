"""Pair sums over a stream of trips: the same aggregate as in batch, kept as a table of versions.

The table is cut into buckets by station pair. A batch brings the pairs whose
sums have changed; only their buckets are written anew, in a folder of the
batch's own. A manifest names the folder of every bucket, and is published in
one step after all files are there: it is the version. A batch that is run
again after a crash finds its manifest, or writes its folder once more.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import pair_sums
from ..sources.files import delete, names_in, published, text_of

BUCKETS = 32
#: Versions that stay readable.
KEPT = 3


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of the published manifests, the latest last."""
    return [n for n in names_in(spark, f"{path}/versions") if n.endswith(".json")]


def folders(spark: SparkSession, path: str, version: str | None = None) -> dict[str, str]:
    """Bucket to the name of its folder in the latest, or a given, version."""
    known = versions(spark, path)
    return json.loads(text_of(spark, f"{path}/versions/{version or known[-1]}")) if known else {}


def current_pairs(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """origin_id, dest_id, ridership of the latest, or a given, version: a whole one, whatever is being written meanwhile."""
    return _bucketed(spark, path, folders(spark, path, version)).drop("bucket")


def _bucketed(spark: SparkSession, path: str, found: dict[str, str]) -> DataFrame:
    schema = "origin_id int, dest_id int, ridership decimal(38,4), bucket int"
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(f"{schema}, batch string").parquet(*[f"{path}/{name}/bucket={b}" for b, name in found.items()]).drop("batch")


def merged(changes: DataFrame, batch: int, path: str, buckets: int = BUCKETS) -> None:
    """Puts the new sums of some pairs (origin_id, dest_id, ridership) in the place of the old ones, as the version of ``batch``.

    A batch that has been merged changes nothing. Old files of other buckets
    stay where they are.
    """
    spark = changes.sparkSession
    manifest = f"{batch:012d}.json"
    if manifest in versions(spark, path):
        return
    was = folders(spark, path)
    new = changes.withColumn("bucket", F.pmod(F.xxhash64("origin_id", "dest_id"), F.lit(buckets)).cast("int")).select("origin_id", "dest_id", F.col("ridership").cast("decimal(38,4)").alias("ridership"), "bucket")
    touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # buckets
    old = _bucketed(spark, path, {b: was[b] for b in touched if b in was})
    rows = old.join(new, ["origin_id", "dest_id"], "left_anti").unionByName(new)
    name = f"batch={batch:012d}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    published(spark, f"{path}/versions/{manifest}", json.dumps(was | dict.fromkeys(touched, name)))
    tidied(spark, path)


def tidied(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Deletes versions before the last ``kept`` ones, and folders that no version needs any more."""
    known = versions(spark, path)
    needed = {name for v in known[-kept:] for name in folders(spark, path, v).values()}
    for v in known[:-kept]:
        delete(spark, f"{path}/versions/{v}")
    for name in names_in(spark, path):
        if name.startswith("batch=") and name not in needed and known and name < f"batch={known[-1][:12]}":
            delete(spark, f"{path}/{name}")


def running_pairs(trips: DataFrame, days: tuple[str, ...] | None, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a query that keeps exact sums of all pairs, to be read by :func:`current_pairs`.

    State is one row a station pair, so no watermark is needed. In update mode
    a batch carries the changed pairs only, with their whole sums, so putting
    them in place twice is as good as once.
    """
    write = lambda found, batch: merged(found, batch, path, buckets)
    return pair_sums(trips, days).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
