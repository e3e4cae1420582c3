"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself. Every document is cut into phrases: runs
of windows (``WINDOW`` words) that select the same anchor, the least hash of a
short word sequence within them. The anchors index the reference: all phrases
with one anchor form a reference block, and a phrase can only occur in the
block of its anchor, so each document meets every block that it can match
without being compared with others.

In its block a phrase is parsed greedily from left to right: where a window
starts anew, the block's phrases that start earlier are searched for the
longest match (a suffix order of the block gives the neighbours that have it),
and the match, compared word by word, is the next factor: source, offset and
length. The windows across a factor's end are looked up again on their own, so
that no window is lost between two factors. Factors of a window or more are
duplicate spans and are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PART, PLACES, Block, blocks, each_block
from .common import document_rows, prefix_sums, selected, small_batches, span_hash, spread_join, stored, unpacker

#: A factor has at least so many words.
WINDOW = 20
#: Words of an anchor.
ANCHOR = 6


def phrases(window: int = WINDOW, anchor: int = ANCHOR):
    """The phrases of a text as places: their anchor, and the words of all windows that select it."""

    def found(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        n = len(words)
        if n < window:
            return None
        at = np.arange(n - anchor + 1)
        grams = span_hash(prefix_sums(words), at, at + anchor)
        chosen = selected(grams, window - anchor + 1)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], len(chosen)) - 1
        return grams[chosen[first]], first, chosen[first], last + window

    return found


def nearest_earlier(time: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it in its group that has a smaller time, -1 if there is none."""
    found = np.arange(len(time)) - 1
    found[np.concatenate(([True], group[1:] != group[:-1]))] = -1
    todo = np.flatnonzero((found >= 0) & (time[found] >= time))
    while len(todo):
        found[todo] = found[found[todo]]  # all between have no smaller time
        todo = todo[found[todo] >= 0]
        todo = todo[time[found[todo]] >= time[todo]]
    return found


def longest_sources(block: Block, p: np.ndarray, codes: np.ndarray, l: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``wanted`` (indices into the places ``p``, sorted by window and words after it) the source of the longest match, and its words after the key; -1 if there is none.

    Among earlier places with the same window the longest match is next to a
    place in this order, before or after it.
    """
    time = block.time[p]
    before = nearest_earlier(time, codes)
    after = len(p) - 1 - nearest_earlier(time[::-1], codes[::-1])[::-1]
    after[after == len(p)] = -1
    source, reach = np.full(len(wanted), -1), np.full(len(wanted), -1)
    for side in (before[wanted], after[wanted]):
        has = np.flatnonzero(side >= 0)
        own, other = p[wanted[has]], p[side[has]]
        words = block.common_right(own, other)
        better = (words >= block.around - l) & ((words > reach[has]) | (words == reach[has]) & (block.time[other] < block.time[source[has]]))
        source[has[better]], reach[has[better]] = other[better], words[better]
    return source, reach


def parsed(block: Block) -> tuple[list[tuple], list[tuple]] | None:
    """Factors (place, words before the key, words after it, source place) of all phrases of a block, and the windows
    (places, words before the key) of split blocks that are new in their part; None if some factor's words differ from
    its source's."""
    reach = np.full(len(block.at), -1)  # words after the key that the latest factor of a phrase covers
    rank = np.empty(len(block.at), np.int64)
    rank[np.lexsort(block.right.T[::-1])] = np.arange(len(rank))
    factors, new = [], []
    for l in range(block.around, -1, -1):
        places, codes = block.windows(l)
        order = np.lexsort((rank[places], codes))
        p, codes = places[order], codes[order]
        wanted = np.flatnonzero(reach[p] < block.around - l)
        if not len(wanted):
            continue
        source, words = longest_sources(block, p, codes, l, wanted)
        has = source >= 0
        own = p[wanted[has]]
        reach[own] = words[has]
        if block.slices(own, l, words[has]) != block.slices(source[has], l, words[has]):
            return None
        factors.append((own, np.full(len(own), l), words[has], source[has]))
        none = p[wanted[~has]]
        new.append((none[block.split[none]], l))
    return factors, new


_FACTORS = "row long, k long, start int, end int, source_id long, source_start int, code binary"


def _parse(window: int, anchor: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in _FACTORS.split(", ")]
        for block, (factors, new) in each_block(batches, anchor, window - anchor, PLACES, parsed):
            if factors:
                place, before, after, source = (np.concatenate(x) for x in zip(*factors))
                if len(place):
                    start, end = block.at[place] - before, block.at[place] + anchor + after
                    yield pa.RecordBatch.from_arrays([
                        pa.array(block.row[place]), pa.array(block.k[place], mask=block.null[place]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                        pa.array(block.k[source], mask=block.null[source]), pa.array((block.at[source] - before).astype(np.int32)), pa.nulls(len(place), pa.binary()),
                    ], names)
            for place, l in new:
                if len(place):
                    start = (block.at[place] - l).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(block.row[place]), pa.array(block.k[place], mask=block.null[place]), pa.array(start), pa.array(start + np.int32(window)),
                        pa.nulls(len(place), pa.int64()), pa.nulls(len(place), pa.int32()), pa.array(block.digests(place, l), pa.binary()),
                    ], names)

    return run


def factors(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, part: int = PART) -> DataFrame:
    """row, start, end, source_id, source_start (words) of the factors of every document of :func:`document_rows`; they may overlap."""
    shared, looped = blocks(rows, phrases(window, anchor), part)
    found = stored(shared.mapInArrow(_parse(window, anchor), _FACTORS), "factors", clean=True)
    names = ["row", "start", "end", "source_id", "source_start"]
    # Split blocks: windows that are new in their part meet those of the other parts.
    opened = found.filter("code IS NOT NULL").withColumn("place", F.struct(F.col("k").isNull().alias("no"), "k", "start"))
    firsts = stored(opened.groupBy("code").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("count")).filter("first < last"), "first-windows", clean=True)
    met = spread_join(opened.select("code", "row", "start", "end", "place"), firsts.drop("count"), ["code"], firsts.select("code", "count"), "row", part)
    late = met.filter(F.col("place") > F.col("first")).select("row", "start", "end", F.col("first.k").alias("source_id"), F.col("first.start").alias("source_start"))
    # a loop is one factor: its source is the text itself, a period before
    own = looped.filter(F.col("end") - F.col("start") - F.col("period") >= window).select("row", (F.col("start") + F.col("period")).cast("int").alias("start"), "end", F.col("k").alias("source_id"), F.col("start").alias("source_start"))
    return found.filter("code IS NULL").select(*names).unionAll(late).unionAll(own)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


_FACTOR = "struct<start:int,end:int,source_id:bigint,source_start:int>"
_CUT = f"doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>, factors array<{_FACTOR}>"


def span_lists(each: list[list[tuple[int, int]]]):
    """An Arrow column of lists of spans."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    flat = np.array([x for spans in each for x in spans], np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))


def listed_spans(column) -> Iterator[list[tuple[int, int]]]:
    """The union of the intervals (start, end) in each list of an Arrow column."""
    ends = column.offsets.to_numpy()
    found = column.flatten()
    start, end = (found.field(c).to_numpy() for c in ("start", "end"))
    for a, z in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist()):
        yield merged(start[a:z], end[a:z])


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    unpack = unpacker()
    for batch in batches:
        n, removed, kept, spans = [], [], [], list(listed_spans(batch["factors"]))
        for z, own in zip(batch["z"].to_pylist(), spans):
            words = unpack(z).split()
            n.append(len(words))
            for s, e in reversed(own):
                del words[s:e]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        columns = [batch["k"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), span_lists(spans), batch["factors"]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text", "spans", "factors"])


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space), spans (words removed) and factors of every document.

    A word is removed if a window of ``window`` words of its document that
    covers it also starts earlier: in a document of smaller id, or in the same
    one further left. A factor names the words that it covers and where they
    start earlier. A null id comes after all others; rows with the same id
    count as one document in this order, so that none of them is earlier at the
    same place. Null, empty and shorter texts lose nothing. An empty table
    gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = document_rows(docs, doc_id, text)
    # as many factors of a document as it has words, at most
    of_document = factors(rows, window, part=part).groupBy("row").agg(F.collect_list(F.struct("start", "end", "source_id", "source_start")).alias("factors"))
    found = F.coalesce("factors", F.array().cast(f"array<{_FACTOR}>")).alias("factors")
    return rows.join(of_document, "row", "left").select("k", "z", found).mapInArrow(_cut, _CUT)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
