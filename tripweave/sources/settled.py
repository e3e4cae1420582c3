"""Tables that are written once, so that what follows neither recomputes nor replans what led to them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a session that names none gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its plan is one scan, and a lost executor takes nothing along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`settled` has written and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == "settled":
            path.getFileSystem(conf).delete(path, True)
