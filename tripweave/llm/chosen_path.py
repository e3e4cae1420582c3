"""Similarity join of documents by the Jaccard similarity of their word n-grams: chosen paths.

Each run of the join follows a path of sampled tokens: sets are split by the
value of one sampled coordinate (the least of their shingles under a hash), and
buckets that are still large by the next one of the path, until buckets are
small enough for brute force. Similar sets share a path with a good
probability, and runs are repeated until the target recall is met. Within a
bucket all pairs are compared: by sketches first, then exactly. A pair that
several runs find counts in the first of them, so links are counted, and
joined to classes, without a list of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_rows, hinted, mix, numbered, prefix_sums, small_batches, span_hash, spread_join, stored, unpacker, whole_groups, words_of
from .components import components

#: Words of a shingle; links join sets whose similarity is NUMERATOR / DENOMINATOR or more.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Coordinates of a sketch, and how many two linked sets share at least (fewer: once in a million).
COORDINATES, SHARED = 64, 36
#: A bucket is compared by brute force up to so many sets, and so many shingles of all its sets (about 60 MB).
LEAF, WEIGHT = 4096, 2_000_000
#: Runs at first; tokens of a path at most; part of the linked pairs to be found.
RUNS, DEPTH, RECALL = 12, 6, 0.9995
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of word sequences of ``size``, sorted; a shorter text is one sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    at = np.arange(max(1, n - size + 1))
    return np.unique(span_hash(prefix_sums(words), at, np.minimum(at + size, n)))


def sketch(found: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the shingles under its hash, 32 bits of it."""
    if not len(found):
        return np.zeros(COORDINATES, np.uint32)
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 2048):
        part = found[i : i + 2048]
        least = np.minimum(least, ((part[None, :] ^ (_SEEDS[:, None] >> np.uint64(7))) * _SEEDS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32) ^ least.astype(np.uint32)


def path(run: int) -> list[int]:
    """The coordinates that a run splits by, in order."""
    rest = [c for c in np.random.default_rng(run).permutation(COORDINATES).tolist() if c != run % COORDINATES]
    return [run % COORDINATES, *rest][:DEPTH]


def _sketches(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        unpack = unpacker()
        for batch in batches:
            sets = [shingles(words_of(unpack(z))[0], size) for z in batch["z"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["k"], pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                ["row", "k", "d", "n", "sketch"],
            )

    return run


def _token(run: int, depth: int) -> Column:
    return F.substring("sketch", 4 * path(run)[depth] + 1, 4)


def leaves(sets: DataFrame, runs: range, leaf: int = LEAF) -> tuple[DataFrame, int, DataFrame | None]:
    """d, run, key, count, weight (shingles) of the sets' buckets with company after splitting; the longest path; the sets on long paths."""
    first = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), _token(r, 0)).alias("key")) for r in runs])
    current = sets.select("d", "n", "sketch", F.explode(first).alias("x")).select("d", "n", "sketch", "x.run", "x.key")
    found, deep, depth = None, None, 1
    while True:
        counts = stored(current.groupBy("run", "key").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("weight")).filter("count > 1"), "buckets")
        large = counts.filter(F.col("count") > leaf)
        more = large.count() if depth < DEPTH else 0
        here = current.select("d", "run", "key").join(counts if not more else counts.filter(F.col("count") <= leaf), ["run", "key"])
        found = here if found is None else found.unionAll(here)
        if not more:
            return found, depth, deep
        token = F.coalesce(*[F.when(F.col("run") == r, _token(r, depth)) for r in runs])
        current = stored(current.join(hinted(large.select("run", "key"), 200_000), ["run", "key"]).select("d", "n", "sketch", "run", F.xxhash64("key", token).alias("key")), "split")
        depth += 1
        if depth == 3:
            deep = current.select("d", "n", "sketch").distinct()


def runs_for(depth: int, recall: float = RECALL) -> int:
    """Runs after which a pair that just reaches the threshold has shared a path of this length with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (NUMERATOR / DENOMINATOR) ** depth))


def all_leaves(sets: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """Buckets of as many runs as the recall needs, and the number of runs. Only sets on long paths need further runs."""
    found, depth, deep = leaves(sets, range(RUNS), leaf)
    needed = min(COORDINATES, runs_for(depth))
    if needed > RUNS and deep is not None:
        more, _, _ = leaves(stored(deep, "deep"), range(RUNS, needed), leaf)
        return found.unionAll(more), needed
    return found, RUNS


def owned_pairs(sketches: np.ndarray, paths: np.ndarray, sizes: np.ndarray, run: int, side: np.ndarray, cross: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set of a bucket the later ones that may be similar and that no earlier run has in a bucket with it."""
    for i in range(len(sizes) - 1):
        js = np.arange(i + 1, len(sizes))
        near = (np.minimum(sizes[js], sizes[i]) * DENOMINATOR >= np.maximum(sizes[js], sizes[i]) * NUMERATOR)
        if cross:
            near &= side[js] != side[i]
        js = js[near]
        js = js[(sketches[js] == sketches[i]).sum(axis=1) >= SHARED]
        if len(js):
            together = (paths[js] == paths[i]) & (paths[i] != 0)
            js = js[together.argmax(axis=1) == run]
        if len(js):
            yield i, js


class Bucket:
    """The rows of one bucket as arrays."""

    def __init__(self, rows: dict[str, list], runs: int):
        self.d = rows["d"]
        self.run = int(rows["run"][0])
        self.sizes = np.array(rows["n"], np.int64)
        self.copies = np.array(rows["copies"], np.int64)
        self.side = np.array(rows["side"], np.int64)
        self.cross = bool(rows["cross"][0])
        self.sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint32).reshape(-1, COORDINATES)
        self.paths = np.frombuffer(b"".join(rows["paths"]), np.int64).reshape(-1, runs)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        return owned_pairs(self.sketches, self.paths, self.sizes, self.run, self.side, self.cross)


def _buckets(batches: Iterator, columns: list[str], runs: int, rows: int, size: int = 16 << 20) -> Iterator[tuple[Bucket, dict]]:
    for table in whole_groups(batches, ["bucket"], rows, size):
        key = table["bucket"].to_numpy()
        names = table["d"].to_pylist()
        once = [i for i, d in enumerate(names) if not i or d != names[i - 1] or key[i] != key[i - 1]]  # repeated rows come once
        if len(once) < len(names):
            table, key = table.take(once), key[once]
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        lists = {c: table[c].to_pylist() for c in columns}
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if z - a > 1:
                part = {c: x[a:z] for c, x in lists.items()}
                yield Bucket(part, runs), part


_ROW = ["bucket", "run", "d", "n", "copies", "side", "cross", "sketch", "paths"]


def _candidates(runs: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bucket, rows in _buckets(batches, _ROW, runs, 8192):
            wanted = np.zeros(len(bucket.d), bool)
            for i, js in bucket.pairs():
                wanted[i] = True
                wanted[js] = True
            if wanted.any():
                yield pa.RecordBatch.from_pydict({c: [x for x, w in zip(rows[c], wanted) if w] for c in ("d", "bucket", "run", "side", "cross")}, _SCHEMA())

    return run


def _SCHEMA():
    import pyarrow as pa

    return pa.schema([("d", pa.binary()), ("bucket", pa.int64()), ("run", pa.int32()), ("side", pa.int32()), ("cross", pa.bool_())])


def linked(sets: list[np.ndarray], pairs: Iterator[tuple[int, np.ndarray]], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of linked documents of each set, and the first set of its component within the bucket, from exact similarities."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.unique(np.concatenate(sets))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.empty(starts[-1], np.int32)
    for i, own in enumerate(sets):
        ids[starts[i] : starts[i + 1]] = np.searchsorted(values, own)
    del sets
    mark = np.zeros(len(values), np.int32)
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in pairs:
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = 1
        for block in np.array_split(js, -(-len(js) // 512)):
            both = np.add.reduceat(mark[np.concatenate([ids[starts[j] : starts[j + 1]] for j in block])], np.concatenate(([0], np.cumsum(sizes[block])[:-1])))
            good = block[both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (sizes[i] + sizes[block])]
            links[i] += copies[good].sum()
            links[good] += copies[i]
            a = root(i)
            for j in good[parent[good] != a].tolist():
                b = root(j)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
        mark[own] = 0
    return links, np.array([root(x) for x in range(n)], np.int64)


def _links(runs: int, size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unpack = unpacker()
        for bucket, rows in _buckets(batches, [*_ROW, "z"], runs, 2048, 8 << 20):
            pairs = bucket.pairs()
            if (one := next(pairs, None)) is not None:
                links, first = linked([shingles(words_of(unpack(z))[0], size) for z in rows["z"]], chain((one,), pairs), bucket.copies)
                got = np.flatnonzero(links)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket.d[i] for i in got], pa.binary()), pa.array(links[got]), pa.array([bucket.d[first[i]] for i in got], pa.binary())], ["d", "links", "first"])

    return run


def with_paths(found: DataFrame, sets: DataFrame, runs: int) -> DataFrame:
    """Each bucket's sets with their sketches and the keys of all their paths; a bucket that stayed large, or has very long texts, is dealt into pairs of parts."""
    keys = found.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("run", "key"))).alias("keys"), F.collect_list(F.struct("run", "key", "count", "weight")).alias("buckets"))
    hexed = F.concat(*[F.coalesce(F.reverse(F.unhex(F.lpad(F.hex(F.col("keys")[r]), 16, "0"))), F.unhex(F.lit("00" * 8))) for r in range(runs)])
    each = sets.join(keys, "d").select("d", "n", "copies", "sketch", hexed.alias("paths"), F.explode("buckets").alias("b"))
    # a pair of parts weighs no more than an undivided bucket
    parts = F.ceil(F.greatest(F.col("b.count") / LEAF, F.when(F.col("b.weight") > WEIGHT, F.col("b.weight") * 2 / WEIGHT).otherwise(1))).cast("int")
    own = F.pmod(F.xxhash64("d"), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, own).alias("a"), F.greatest(p, own).alias("z")))
    dealt = each.withColumn("pair", F.explode(others)).withColumn("side", own)
    return dealt.select(
        F.xxhash64("b.run", "b.key", "pair.a", "pair.z").alias("bucket"), F.col("b.run").alias("run"), "d", "n", "copies", "side",
        (F.col("pair.a") != F.col("pair.z")).alias("cross"), "sketch", "paths",
    )


def similarity_classes(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row, doc_id, class_id, n_links and kept of every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of
    ``size``-word shingles is 0.8 or more; a shorter text is one shingle, and
    null, empty and blank texts, without any, are linked to each other. A class
    holds the rows that links connect; ``class_id`` is its smallest id (null
    comes last), and one row with it is ``kept``. ``n_links`` counts a row's
    linked rows, copies and repeated rows included. ``row`` tells rows apart
    and may name a column that does so already. An empty table gives no rows;
    other columns are ignored.

    Copies (equal sets) are one set in the join. Links are exact: sketches only
    leave pairs out that are linked once in a million; the runs find RECALL of
    the links at the threshold and more of closer ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = document_rows(docs, doc_id, text, row)
    all_sets = stored(rows.mapInArrow(_sketches(size), "row long, k long, d binary, n int, sketch binary"), "sketches")
    first_of = F.min(F.struct(F.col("k").isNull().alias("no"), "k", "row"))
    sets = stored(all_sets.groupBy("d").agg(first_of.alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sets")
    found, runs = all_leaves(sets.filter("n > 0").select("d", "n", "sketch"))
    # adaptive execution sizes the partitions, so that small tables are not written as many tiny files
    deal = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "d")
    members = with_paths(found, sets.select("d", "n", "copies", "sketch"), runs)
    wanted = stored(deal(members).mapInArrow(_candidates(runs), "d binary, bucket long, run int, side int, cross boolean"), "candidates")
    # Only sets with a candidate partner travel with their text, to each bucket that has to compare them.
    buckets = wanted.groupBy("d").agg(F.collect_list(F.struct("bucket", "run", "side", "cross")).alias("buckets"))
    # d -> the row of the first copy, and the keys of all paths once more
    paths = members.select("d", "n", "copies", "sketch", "paths").dropDuplicates(["d"])
    known = sets.select("d", "first.row").join(buckets, "d").join(paths, "d")
    texts = rows.select("row", "z").join(known, "row")
    compared = texts.select("d", "n", "copies", "sketch", "paths", "z", F.explode("buckets").alias("b")).select("b.*", "d", "n", "copies", "sketch", "paths", "z")
    links = stored(deal(compared).mapInArrow(_links(runs, size), "d binary, links long, first binary"), "links")
    star = components(links.select(F.col("d").alias("u"), F.col("first").alias("v")))
    label = sets.select("d", "first", "copies").join(star.select(F.col("u").alias("d"), F.col("v").alias("root")), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = label.groupBy("root").agg(F.min("first").alias("least"))
    degree = links.groupBy("d").agg(F.sum("links").alias("links"))
    of_set = stored(label.join(least, "root").join(degree, "d", "left").select("d", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    # one set may hold a third of all rows
    each = spread_join(all_sets.select("row", "k", "d"), of_set, ["d"], sets.select("d", F.col("copies").alias("count")), "row")
    return each.select("row", F.col("k").alias("doc_id"), F.col("least.k").alias("class_id"), "n_links", (F.col("row") == F.col("least.row")).alias("kept"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`similarity_classes` keeps: one of each class.

    Rows are told apart by a number, so of repeated rows, and of copies with
    null ids, exactly one stays. An empty table gives no rows.
    """
    rows, number = numbered(docs)
    staying = similarity_classes(rows, doc_id=doc_id, text=text, row=number).filter("kept").select(F.col("row").alias(number))
    return rows.join(staying, number, "left_semi").select(*docs.columns)
