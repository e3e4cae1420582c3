"""Near-duplicate documents by fast similarity sketching.

A sketch has a bin for each coordinate. In every round each shingle throws a
value, which grows with the round, into a bin that the round's hash chooses;
a bin keeps its least value. Rounds go on until no bin is empty; those of the
second half fill one stated bin each, so every bin is filled in the end, and
the share of equal bins concentrates around the sets' similarity. Bands of bins
bring similar sets into buckets, whose sketches tell candidates; groups of
candidates are verified over their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import SHINGLE, shingles
from .common import discard, document_rows, mix, numbered, small_batches, spread_join, stored, unpacker, whole_groups, words_of
from .components import components

#: Linked are sets whose intersection has NUMERATOR of DENOMINATOR parts of their union or more.
NUMERATOR, DENOMINATOR = 85, 100
#: Bins of a sketch; bands and bins of a band: at the threshold no band is equal in 5 of 100,000 pairs.
BINS, BANDS, ROWS = 128, 21, 6
#: Equal bins of candidates: six standard deviations below what the threshold lets expect.
SHARED = 84
#: A group is compared in one piece up to so many sets, and so many shingles of all its sets.
LEAF, WEIGHT = 2048, 2_000_000
#: Values that are thrown at a time.
STEP = 1 << 14
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_EMPTY = np.uint64(2**64 - 1)
_SET = "row long, k long, d binary, n int, sketch binary"


def filled(found: np.ndarray) -> np.ndarray:
    """The least value of each bin, with its round in the upper 16 bits, for a set of one hash or more."""
    least = np.full(BINS, _EMPTY)
    at_once, done = max(1, STEP // len(found)), 0
    while done < 2 * BINS and (least == _EMPTY).any():
        turns = np.arange(done, min(done + at_once, BINS if done < BINS else 2 * BINS))
        for i in range(0, len(found), STEP):
            thrown = mix(found[None, i : i + STEP] ^ _SEEDS[turns][:, None])
            bins = thrown >> np.uint64(57) if done < BINS else np.broadcast_to((turns - BINS)[:, None], thrown.shape)
            value = (turns.astype(np.uint64)[:, None] << np.uint64(48)) | (thrown & np.uint64(2**48 - 1))
            np.minimum.at(least, bins.ravel().astype(np.intp), value.ravel())
        done = int(turns[-1]) + 1
    return least


def sketch(found: np.ndarray) -> np.ndarray:
    """16 bits of each bin; of no shingles zeros."""
    return (mix(filled(found)) >> np.uint64(48)).astype(np.uint16) if len(found) else np.zeros(BINS, np.uint16)


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """The distinct hashes of the sequences of ``size`` words, A-Z in lower case; a shorter text is one sequence."""
    return shingles(words_of(data.lower())[0], size)  # of bytes, lower() changes A-Z alone


def _sketches(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        unpack = unpacker()
        for batch in batches:
            sets = [shingle_set(unpack(z), size) for z in batch["z"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["k"], pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                ["row", "k", "d", "n", "sketch"],
            )

    return run


class Group:
    """Sets that are compared with each other: their sizes, sketches and, if it was dealt into parts, which side each is on."""

    def __init__(self, sizes, sketches: list[bytes], sides=None):
        self.sizes = np.asarray(sizes, np.int64)
        self.sketches = np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, BINS)
        self.sides = None if sides is None else np.asarray(sides)
        self.label = np.arange(len(self.sizes))

    def candidates(self, i: int) -> np.ndarray:
        """Later sets that may be linked to ``i`` and are not yet connected with it."""
        js = i + 1 + np.flatnonzero(self.label[i + 1 :] != self.label[i])
        near = DENOMINATOR * np.minimum(self.sizes[js], self.sizes[i]) >= NUMERATOR * np.maximum(self.sizes[js], self.sizes[i])
        if self.sides is not None:
            near &= self.sides[js] != self.sides[i]
        js = js[near]
        return js[(self.sketches[js] == self.sketches[i]).sum(axis=1) >= SHARED]

    def connect(self, i: int, js: np.ndarray) -> None:
        if len(js):
            joined = np.append(self.label[js], self.label[i])
            self.label[np.isin(self.label, joined)] = joined.min()

    def by_sketches(self) -> np.ndarray:
        """The first of the sets that each is connected with through candidates."""
        for i in range(len(self.sizes) - 1):
            self.connect(i, self.candidates(i))
        return self.label

    def by_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        """The same through links, worked out over whole sets."""
        for i in range(len(self.sizes) - 1):
            js = self.candidates(i)
            for block in np.array_split(js, max(1, -(-int(self.sizes[js].sum()) // WEIGHT))):
                if len(block):
                    both = shared(sets[i], [sets[j] for j in block])
                    self.connect(i, block[linked(both, self.sizes[i], self.sizes[block])])
        return self.label


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of ``own`` each of the others has."""
    values = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    return np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in others])[:-1])))


def linked(both, m, n):
    """Whether sets of m and n elements that have ``both`` in common are linked."""
    return DENOMINATOR * both >= NUMERATOR * (m + n - both)


def _groups(batches: Iterator, rows: int, size: int) -> Iterator[tuple[dict, Group]]:
    for table in whole_groups(batches, ["bucket"], rows, size):
        key = table["bucket"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if z - a > 1:
                part = table.slice(a, z - a).to_pydict()
                yield part, Group(part["n"], part["sketch"], part["side"] if part["cross"][0] else None)


def _edges(part: dict, label: np.ndarray):
    import pyarrow as pa

    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array([part["d"][i] for i in at], pa.binary()), pa.array([part["d"][label[i]] for i in at], pa.binary())], ["u", "v"])


def _near(batches: Iterator) -> Iterator:
    for part, group in _groups(batches, 16_384, 16 << 20):
        yield _edges(part, group.by_sketches())


def _verified(size: int):
    def run(batches: Iterator) -> Iterator:
        unpack = unpacker()
        for part, group in _groups(batches, LEAF, 8 << 20):
            yield _edges(part, group.by_sets([shingle_set(unpack(z), size) for z in part["z"]]))

    return run


def _gaps(size: int):
    """Distance (1 - similarity) of each set to the hub of its cell, and whether they are linked."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unpack, last, hub = unpacker(), None, None
        for batch in batches:
            gaps, links = [], []
            for z, hub_z in zip(batch["z"].to_pylist(), batch["hub_z"].to_pylist()):
                if hub_z != last:
                    last, hub = hub_z, shingle_set(unpack(hub_z), size)
                own = shingle_set(unpack(z), size)
                both = int(shared(hub, [own])[0])
                gaps.append(1 - both / (len(hub) + len(own) - both))
                links.append(bool(linked(both, len(hub), len(own))))
            yield pa.RecordBatch.from_arrays([batch["cell"], batch["d"], batch["hub"], pa.array(gaps, pa.float64()), pa.array(links)], ["cell", "d", "hub", "gap", "linked"])

    return run


def band_keys(sets: DataFrame) -> DataFrame:
    """d, key: one row for each band of each set."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("sketch", b * width + 1, width)) for b in range(BANDS)]
    return sets.select("d", F.explode(F.array(*keys)).alias("key"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", "d")


def candidate_cells(sets: DataFrame, leaf: int = LEAF) -> DataFrame:
    """d, cell: sets that candidates connect, whether directly or not, have one cell; sets without candidates are left out.

    Of a bucket of more than ``leaf`` sets all are taken for candidates; what
    that brings together needlessly the verification takes apart.
    """
    keys = band_keys(sets)
    counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("d").alias("least")).filter("count > 1"), "bands")
    placed = stored(spread_join(keys, counts, ["key"], counts, "d"), "placed")
    large = placed.filter((F.col("count") > leaf) & (F.col("d") != F.col("least"))).select(F.col("d").alias("u"), F.col("least").alias("v"))
    own = placed.filter(F.col("count") <= leaf).groupBy("d").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    members = sets.join(own, "d").select(F.explode("keys").alias("bucket"), "d", "n", "sketch", F.lit(0).alias("side"), F.lit(False).alias("cross"))
    edges = stored(large.unionAll(_dealt(members).mapInArrow(_near, "u binary, v binary")), "candidates")
    found = components(edges)
    return found.select(F.col("u").alias("d"), F.col("v").alias("cell")).unionAll(found.select(F.col("v").alias("d"), F.col("v").alias("cell")).distinct())


def _checked(members: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """u, v: links that connect the sets of each bucket of ``members`` (bucket, d, row, n, sketch, side, cross)."""
    travelling = members.groupBy("d", "row", "n", "sketch").agg(F.collect_list(F.struct("bucket", "side", "cross")).alias("b"))  # a text is looked up once
    texts = rows.select("row", "z").join(travelling, "row").select(F.explode("b").alias("b"), "d", "n", "sketch", "z").select("b.*", "d", "n", "sketch", "z")
    return _dealt(texts).mapInArrow(_verified(size), "u binary, v binary")


def in_parts(members: DataFrame, leaf: int, weight: int) -> DataFrame:
    """``members`` (bucket, d, n, ...), where a bucket that is too large becomes one for every pair of its parts."""
    totals = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("weight")).filter("count > 1")
    parts = F.ceil(F.greatest(F.col("count") / leaf, F.when(F.col("weight") > weight, F.col("weight") * 2 / weight).otherwise(1))).cast("int")
    own = F.pmod(F.xxhash64("d"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("side")).alias("a"), F.greatest(p, F.col("side")).alias("z")))
    each = members.join(totals.withColumn("parts", parts), "bucket").withColumn("side", own).withColumn("pair", F.explode(pairs))
    return each.select(F.xxhash64("bucket", "pair.a", "pair.z").alias("bucket"), "d", "row", "n", "sketch", "side", (F.col("pair.a") != F.col("pair.z")).alias("cross"))


def links_of_large(members: DataFrame, totals: DataFrame, rows: DataFrame, size: int, leaf: int, weight: int) -> DataFrame:
    """u, v: links that connect the sets of large cells. ``members``: cell, d, row, n, sketch; ``totals``: cell, count.

    Every set is compared with one of its cell, the hub, which links a group
    of near copies however large it is. Distances obey the triangle
    inequality: a set linked to the hub is only compared again if one that is
    not may be as near to it as a link asks. Those sets meet in their bands'
    buckets, and a bucket that is too large in pairs of its parts.
    """
    hubs = members.groupBy("cell").agg(F.min(F.struct(F.xxhash64("d"), "d", "row")).alias("h")).select("cell", F.col("h.d").alias("hub"), F.col("h.row").alias("row"))
    known = hubs.join(rows.select("row", F.col("z").alias("hub_z")), "row").drop("row")
    texts = members.select("cell", "d", "row").join(rows.select("row", "z"), "row")
    beside = spread_join(texts, known, ["cell"], totals, "d", least=256).select("cell", "d", "z", "hub", "hub_z")
    gaps = stored(beside.mapInArrow(_gaps(size), "cell binary, d binary, hub binary, gap double, linked boolean"), "gaps")
    reach = gaps.filter("NOT linked").groupBy("cell").agg((F.min("gap") - (1 - NUMERATOR / DENOMINATOR) - 1e-9).alias("reach"))
    left = gaps.join(reach, "cell").filter("NOT linked OR gap >= reach").select("d")
    rest = stored(members.join(left, "d", "left_semi"), "rest")
    keyed = band_keys(rest).join(rest.select("d", "row", "n", "sketch"), "d").select(F.col("key").alias("bucket"), "d", "row", "n", "sketch")
    return gaps.filter("linked AND d <> hub").select(F.col("d").alias("u"), F.col("hub").alias("v")).unionAll(_checked(in_parts(keyed, leaf, weight), rows, size))


def near_components(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", row: str | None = None, leaf: int = LEAF, weight: int = WEIGHT) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of
    ``size``-word shingles (A-Z in lower case) is 0.85 or more; a shorter text
    is one shingle. Null, empty and blank texts have none and are linked to
    nothing. A component holds the rows that links connect; ``component_id`` is
    its smallest id (null comes last), and one row with it is ``kept``, of
    repeated rows one. ``row`` may name a column that tells rows apart. An
    empty table gives no rows; other columns are ignored.

    Equal sets are one in all comparisons. Links are confirmed over whole sets;
    of pairs at the threshold about five in 100,000 share no band.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = document_rows(docs, doc_id, text, row)
    all_sets = stored(rows.mapInArrow(_sketches(size), _SET), "sketches")
    first_of = F.min(F.struct(F.col("k").isNull().alias("no"), "k", "row"))
    sets = stored(all_sets.filter("n > 0").groupBy("d").agg(first_of.alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sets")
    cells = candidate_cells(sets.select("d", "n", "sketch"), leaf)
    members = stored(cells.join(sets.select("d", "first.row", "n", "sketch"), "d"), "members")
    totals = members.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("weight"))
    large = stored(totals.filter((F.col("count") > leaf) | (F.col("weight") > weight)), "large")
    some = bool(large.head(1))
    small = members.join(large, "cell", "left_anti") if some else members
    whole = small.select(F.xxhash64("cell").alias("bucket"), "d", "row", "n", "sketch", F.lit(0).alias("side"), F.lit(False).alias("cross"))
    found = _checked(whole, rows, size)
    if some:
        found = found.unionAll(links_of_large(spread_join(members, large.select("cell"), ["cell"], large, "d"), large.select("cell", "count"), rows, size, leaf, weight))
    star = components(stored(found, "links"))
    label = sets.select("d", "first", "copies").join(star.select(F.col("u").alias("d"), F.col("v").alias("root")), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = label.groupBy("root").agg(F.min("first").alias("least"))
    of_set = stored(label.join(least, "root").select("d", "least"), "components")
    # one set may hold a third of all rows; those without shingles stand for themselves
    each = spread_join(all_sets.filter("n > 0").select("row", "k", "n", "d"), of_set, ["d"], sets.select("d", F.col("copies").alias("count")), "row")
    told = each.select("row", "k", "n", F.col("least.k").alias("c"), (F.col("row") == F.col("least.row")).alias("kept"))
    alone = all_sets.filter("n = 0").select("row", "k", "n", F.col("k").alias("c"), F.lit(True).alias("kept"))
    return told.unionAll(alone).select("row", F.col("k").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id"), "kept")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`near_components` keeps: one of each component, and all without words."""
    rows, number = numbered(docs)
    staying = near_components(rows, doc_id=doc_id, text=text, row=number).filter("kept").select(F.col("row").alias(number))
    return rows.join(staying, number, "left_semi").select(*docs.columns)
