"""Small files in whatever file system Spark uses, published all at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder in order; none if it is not there."""
    path, system = _at(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []


def delete(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.delete(target, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """The file or folder at ``source`` is at ``target`` then, in place of what was there."""
    (a, system), (b, _) = _at(spark, source), _at(spark, target)
    if system.exists(b):
        system.delete(b, True)
    system.mkdirs(b.getParent())
    if not system.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")


def published(spark: SparkSession, path: str, text: str) -> None:
    """Writes a text beside ``path`` and moves it there, so that a reader sees all of it or nothing."""
    draft, system = _at(spark, path + ".draft")
    out = system.create(draft, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    moved(spark, path + ".draft", path)


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
