"""Blocks: places of documents that share a key meet with the words around them, however many share it.

A place is a short word sequence, selected by content, with a context around
it. Places whose key stands nowhere else are dropped before any words travel.
The places of a key form a block; a block of more than PART places is dealt
into parts, which are compared one by one and then with each other through the
few windows that are new in their part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, discard, mix, partitions, spread_join, stored, unpacker, whole_groups, words_of

#: Places, about, of a part of a block.
PART = 4096
#: A loop repeats words up to so many words on, and so often at least.
PERIOD, LOOP = 14, 256
#: Bytes, about, of the contexts that go on at a time.
CONTEXTS = 16 << 20
#: Places and bytes of contexts, about, that are compared at a time; a part is never cut.
PLACES, BYTES = 8_192, 16 << 20
_PLACE = ["row", "key", "lo", "at", "hi"]
#: Word hashes of a text to the keys of its places, the first and one past the last word of their contexts, and where the key's words start.
Places = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]


def loops(words: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (start, end, period) of a text in which every word stands again ``period`` words on, LOOP times or more one after the other.

    Short periods only, which would make places of most words of a text.
    """
    found: list[tuple[int, int, int]] = []
    for period in range(1, PERIOD + 1):
        if len(words) < LOOP + period:
            break
        edges = np.flatnonzero(np.diff(np.concatenate(([False], words[period:] == words[:-period], [False])).astype(np.int8)))
        for a, z in zip(edges[::2].tolist(), (edges[1::2] + period).tolist()):
            if z - period - a < LOOP or any(s <= a and z <= e for s, e, _ in found):
                continue
            own = [data[i:j] for i, j in zip(starts[a:z].tolist(), ends[a:z].tolist())]
            if own[period:] == own[:-period]:  # not by hashes alone
                found.append((a, z, period))
    return found


def _places(found: Places):
    """The places of each text; of a loop only those with words of its first period, or from outside it, and the loop itself: no key, ``at`` its period."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unpack = unpacker()
        for batch in batches:
            parts, again = [], []
            for row, z in zip(batch["row"].to_pylist(), batch["z"].to_pylist()):
                words, starts, ends = words_of(data := unpack(z))
                if (got := found(words)) is not None:
                    inside = np.zeros(len(got[0]), bool)
                    for a, b, period in loops(words, data, starts, ends):
                        inside |= (got[1] >= a + period) & (got[3] <= b)
                        again.append((row, a, period, b))
                    parts.append((np.full(len(got[0]), row)[~inside], *(x[~inside] for x in got)))
            if parts:
                row, key, lo, at, hi = (np.concatenate(x) for x in zip(*parts))
                numbers = [pa.array(x.astype(np.int32)) for x in (lo, at, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key.view(np.int64)), *numbers], _PLACE)
            if again:
                row, *numbers = np.array(again, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(row), pa.int64()), *(pa.array(x.astype(np.int32)) for x in numbers)], _PLACE)

    return run


def word_starts(text: bytes) -> np.ndarray:
    """Where the words of a text start that single spaces separate; at last, one past the space that would follow."""
    return np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]))


def _contexts(batches: Iterator) -> Iterator:
    """The words of each place's context, joined by single spaces."""
    import pyarrow as pa

    unpack = unpacker()
    for batch in batches:
        ends = batch["places"].offsets.to_numpy()
        ends = ends - ends[0]
        place = batch["places"].flatten()
        lo, hi = (place.field(c).to_numpy() for c in ("lo", "hi"))
        of, words, held, begun = [], [], 0, 0
        names = ["key", "part", "split", "lo", "at", "hi"]

        def contexts(upto: int):
            own, rows = place.slice(begun, upto - begun), pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([*(own.field(c) for c in names), batch["row"].take(rows), batch["k"].take(rows), pa.array(words, pa.binary())], [*names, "row", "k", "words"])

        for i, z in enumerate(batch["z"].to_pylist()):
            text = b" ".join(unpack(z).split())
            starts = word_starts(text)
            for n in range(ends[i], ends[i + 1]):
                words.append(text[starts[lo[n]] : starts[hi[n]] - 1])
                of.append(i)
                held += len(words[-1])
                if held > CONTEXTS:
                    yield contexts(n + 1)
                    of, words, held, begun = [], [], 0, n + 1
        yield contexts(len(place))


def blocks(rows: DataFrame, found: Places, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """The shared places of all blocks, and the loops (row, k, start, period, end) of the texts, in which every window stands again a period on.

    The first has key, part, split, lo, at, hi, row, k, words: shared places of :func:`document_rows`, each part in one partition, sorted.

    Within a part places are in the order of the ids (null last), then of
    ``at``. ``split`` says that a block has several parts. A text that repeats
    a few words on and on has few places, however long it is: those of a loop
    stand for all that follow.
    """
    spark = rows.sparkSession
    every = stored(rows.mapInArrow(_places(found), "row long, key long, lo int, at int, hi int"), "places")
    places = every.filter("key IS NOT NULL")
    again = stored(every.filter("key IS NULL").join(rows.select("row", "k"), "row").select("row", "k", F.col("lo").alias("start"), F.col("at").alias("period"), F.col("hi").alias("end")), "loops", clean=True)
    often = stored(places.groupBy("key").count().filter("count > 1"), "shared-keys", clean=True)
    met = spread_join(places, often, ["key"], often, "row", part)
    parts = F.ceil(F.col("count") / part).cast("int")
    # at most as many places of a document as it has words
    listed = stored(
        met.select("row", F.struct("key", F.pmod(F.xxhash64("row", "at"), parts).cast("int").alias("part"), (parts > 1).alias("split"), "lo", "at", "hi").alias("place"))
        .groupBy("row").agg(F.collect_list("place").alias("places")),
        "shared-places",
        clean=True,
    )
    discard(every)
    discard(often)
    contexts = rows.join(listed, "row").select("row", "k", "z", "places").mapInArrow(_contexts, "key long, part int, split boolean, lo int, at int, hi int, row long, k long, words binary")
    return contexts.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", F.col("k").asc_nulls_last(), "at"), again


class Known(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


class Block:
    """Whole parts of blocks as arrays, one line a place; words are hashes, or, in a further ``attempt``, numbers of distinct words, scrambled anew.

    ``left`` and ``right`` are the words beside the key's, outwards, 0 where
    there are none; ``left_sums[:, n]`` and ``right_sums[:, n]`` tell the first
    n of them.
    """

    def __init__(self, table, size: int, around: int, attempt: int = 0):
        self.row, self.at, lo, hi, self.split = (table[c].to_numpy() for c in ("row", "at", "lo", "hi", "split"))
        k = table["k"].combine_chunks()
        self.null = k.is_null().to_numpy(zero_copy_only=False)
        self.k = k.fill_null(0).to_numpy(zero_copy_only=False)
        key, part = table["key"].to_numpy(), table["part"].to_numpy()
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        self.group = np.cumsum(new) - 1
        later = np.ones(n, bool)
        later[1:] = new[1:] | (self.null[1:] != self.null[:-1]) | (self.k[1:] != self.k[:-1]) | (self.at[1:] != self.at[:-1])
        self.time = np.cumsum(later)  # equal for rows of one id at the same place
        self.data = b" ".join(table["words"].to_pylist())
        self.starts = word_starts(self.data)
        if attempt:
            ids = mix(np.fromiter(map(Known().__getitem__, self.data.split()), np.uint64, len(self.starts) - 1) + np.uint64(attempt))
        else:
            ids = words_of(self.data)[0] | np.uint64(1)  # never 0
        base = np.cumsum(hi - lo) - (hi - lo)
        self.pivot = base + self.at - lo
        self.n_left, self.n_right = self.at - lo, hi - self.at - size
        step = np.arange(around)
        pick = lambda where, there: np.where(there, ids[np.clip(where, 0, len(ids) - 1)], np.uint64(0))
        left = pick(self.pivot[:, None] - 1 - step, step < self.n_left[:, None])
        self.right = pick(self.pivot[:, None] + size + step, step < self.n_right[:, None])
        up, _ = POWERS(2 * around + size + 1)
        sums = lambda x, p: np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(x * p, axis=1)), axis=1)
        self.left_sums, self.right_sums = sums(left, up[1 : around + 1]), sums(self.right, up[around + 1 : 2 * around + 1])
        # places meet by the words of the key, not by its hash alone
        gram = (ids[self.pivot[:, None] + np.arange(size)] * up[:size]).sum(axis=1) if attempt else np.uint64(0)
        self.own = mix(mix(self.group.astype(np.uint64) + np.uint64(1)) + gram)
        self.size, self.around = size, around

    def windows(self, l: int) -> tuple[np.ndarray, np.ndarray]:
        """The places that have ``l`` words left of the key's and the rest of a window right of them, and the windows' codes."""
        rows = np.flatnonzero((self.n_left >= l) & (self.n_right >= self.around - l))
        return rows, mix(self.left_sums[rows, l] + self.right_sums[rows, self.around - l]) ^ self.own[rows]

    def common_right(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words after the key's are equal."""
        equal = (self.right[p] == self.right[q]) & (self.right[p] > 0)
        return np.where(equal.all(axis=1), self.around, (~equal).argmax(axis=1))

    def slices(self, places: np.ndarray, before: np.ndarray | int, after: np.ndarray | int) -> list[bytes]:
        """The words from so many before the key to so many after it, as bytes."""
        first, last = self.pivot[places] - before, self.pivot[places] + self.size + after
        return [self.data[a:b] for a, b in zip(self.starts[first].tolist(), (self.starts[last] - 1).tolist())]

    def digests(self, places: np.ndarray, l: int) -> list[bytes]:
        """128 bits of hash of the windows, the same in every task."""
        from xxhash import xxh3_128_digest

        return list(map(xxh3_128_digest, self.slices(places, l, self.around - l)))


def each_block(batches: Iterator, size: int, around: int, rows: int, compared: Callable[[Block], tuple | None]) -> Iterator[tuple[Block, tuple]]:
    """Each block and what ``compared`` finds in it; None, where words that it took for equal differ, means another attempt."""
    for table in whole_groups(batches, ["key", "part"], rows, BYTES):
        for attempt in count():
            block = Block(table, size, around, attempt)
            if (found := compared(block)) is not None:
                break
        yield block, found
