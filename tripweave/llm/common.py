"""What the operators share: intermediate tables, words and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Multiplier of the polynomial word-sequence hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a temporary folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Lets a query delete its shuffle files as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: what follows never recomputes ``df``, and an executor
    that is lost takes none of it along. With ``clean`` the shuffle files of
    this write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(clean or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` has written and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a batch of rows in a Python worker, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(m - 1, BASE, np.uint64))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(m - 1, BASE_INVERSE, np.uint64))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(words: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Running polynomial sums, from which :func:`span_hash` gets the hash of any span."""
    up, _ = powers(len(words) + 1)
    return np.concatenate(([np.uint64(0)], np.cumsum(words * up[:-1])))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of the word sequences [start, end): equal for equal sequences, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_IS_WHITE = np.isin(np.arange(256), list(WHITE.encode()))
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    white = np.ones(len(b) + 2, bool)
    white[1:-1] = _IS_WHITE[b]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_hash(prefix_sums(_OF_BYTE[b]), starts, ends), starts, ends


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text, and where they start and end (bytes).

    Words are what ``bytes.split()`` gives: it separates at exactly the
    characters of ``WHITE``. A long text is hashed in stretches of whole words.
    """
    if len(data) <= STRETCH:
        return _words(data)
    parts, at, border = [], 0, re.compile(rb"[ \t\n\x0b\x0c\r]")
    while at < len(data):
        end = m.start() if (m := border.search(data, at + STRETCH)) else len(data)
        hashes, starts, ends = _words(data[at:end])
        parts.append((hashes, starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return hashes, starts, ends


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` neighbouring grams the place of its least (leftmost of equals): its minimiser."""
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.arange(len(view)) + view.argmin(axis=1)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written out with a number that is unique to each row, and the number's column."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _packed(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress(t.encode()) for t in batch["t"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["k"], z], ["row", "k", "z"])


def unpacker() -> Callable[[bytes], bytes]:
    """Gives back the UTF-8 bytes of a text of :func:`document_rows`."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def document_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row, k, z, written out once: a number unique to each row, the id (or null), the text (null: empty), compressed.

    Rows are joined by their number alone, so neither null nor repeated ids nor
    equal texts are ever taken for each other. ``row`` names a column that has
    such numbers already.
    """
    small_batches(docs.sparkSession)
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    named = docs.select(number.alias("row"), F.col(doc_id).cast("long").alias("k"), text_of(text).alias("t"))
    return stored(named.mapInArrow(_packed, "row long, k long, z binary"), "rows")


#: Keys, at most, that :func:`spread_join` tells every executor about.
HOT_KEYS = 100_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, by: str, least: int = 4096) -> DataFrame:
    """``left`` joined to ``right``, where a few keys may hold a large part of ``left``, and ``right`` has each key once.

    ``counts`` (the columns ``on``, and ``count``) tells how many rows of
    ``left`` a key has. Of keys that have more than a share of 1 / HOT_KEYS of
    all, and more than ``least`` rows, there are HOT_KEYS at most, so they are
    broadcast; their rows are dealt to several tasks by a hash of column ``by``.
    """
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    limit = max(least, -(-total // HOT_KEYS))
    hot = F.broadcast(counts.filter(F.col("count") > limit).select(*on, F.ceil(F.col("count") / limit).cast("int").alias("__spread")))
    dealt = left.join(hot, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__spread")).cast("int"), F.lit(0))).drop("__spread")
    each = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__spread", F.lit(1)) - 1))).drop("__spread")
    return dealt.join(each, [*on, "__salt"]).drop("__salt")


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` (a table of few narrow columns) only if it has at most ``rows`` rows; else let it be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def binary_column(data: np.ndarray, ends: np.ndarray):
    """An Arrow column of the bytes of ``data``, cut at ``ends``."""
    import pyarrow as pa

    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def whole_groups(batches, keys: list[str], rows: int = 65_536, size: int = 64 << 20):
    """Arrow tables from a partition sorted by ``keys``, of about ``rows`` rows or ``size`` bytes, such that no group of equal keys is cut."""
    import pyarrow as pa

    held, n, taken, wanted, room = [], 0, 0, rows, size
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        taken += batch.nbytes
        if n < wanted and taken < room:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(n, bool)
        for key in keys:
            column = table[key].to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
            held, n, wanted, room = table.slice(cut).to_batches(), n - cut, rows, size
            taken = sum(b.nbytes for b in held)
        else:
            held, wanted, room = table.to_batches(), 2 * n, 2 * taken
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
