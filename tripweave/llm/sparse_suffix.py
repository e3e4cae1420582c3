"""Suffix-array deduplication with sparse suffix arrays.

Only suffixes that start at content-selected places are retained: the
minimisers, least hashes of a few words within a sliding window, which two
copies of a passage select alike. Suffixes that share their first words, their
head, meet (others are dropped) and are sorted word by word, words in the order
of their hashes; the common prefix of each two neighbours is measured, and that
of any two suffixes is the least between them. Matches are then extended to the
left, one word after the other: suffixes with the same words before the head
keep their order, so the neighbours among them have the longest common prefix,
and they match if the words before and after make ``MIN_WORDS`` together.

A suffix travels with as many words around its head as a passage of
``MIN_WORDS`` can reach. A longer passage holds a minimiser within each such
reach, so its matches overlap and are joined to the whole of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PART, PLACES, Block, blocks, each_block
from .common import document_rows, prefix_sums, selected, small_batches, span_hash, spread_join, stored
from .rlz import listed_spans, span_lists

#: Passages of at least so many words are found.
MIN_WORDS = 50
#: Words of a gram, and grams of a window: a suffix is retained among so many neighbours.
GRAM, WIDTH = 8, 27


def head_words(min_words: int) -> int:
    """Words that two retained suffixes share at least if they start at the first minimiser within a common passage."""
    return min_words - WIDTH + 1


def retained(min_words: int = MIN_WORDS):
    """The retained suffixes of a text that have a whole head as places: their head, and the words that a passage can reach around it."""
    head = head_words(min_words)

    def found(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        n = len(words)
        if n < min_words:
            return None
        sums = prefix_sums(words)
        at = np.arange(n - GRAM + 1)
        grams = span_hash(sums, at, at + GRAM)
        places = np.unique(selected(grams, min(WIDTH, len(grams))))
        places = places[places + head <= n]
        return span_hash(sums, places, places + head), np.maximum(places - WIDTH + 1, 0), places, np.minimum(places + head + WIDTH - 1, n)

    return found


def suffix_order(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of each part, sorted by their words, and how many words after the head each shares with the next; -1 at a part's end."""
    order = np.lexsort((*block.right.T[::-1], block.own))
    common = block.common_right(order[:-1], order[1:])
    return order, np.where(block.own[order[:-1]] == block.own[order[1:]], common, -1)


def matched(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]] | None:
    """Suffixes, and how many words before and after their head they share at most with others of their part; one suffix
    for each window (places, words before the head) of split blocks. None if words taken for equal differ.

    With more words before the head a suffix shares fewer after it, so of the
    matches of a suffix the one with the fewest words before the head has the
    most after it, just enough for a passage (all that travel, if it has none
    before). All hold its head, so together they are one span; both ends are
    compared word by word with the neighbour's.
    """
    n = len(block.at)
    order, common = suffix_order(block)
    least, most, seen = np.full(n, block.around + 1), np.full(n, -1), []
    first_beside, last_beside = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)  # in the order of suffixes
    for l in range(block.around + 1):
        live = live[block.n_left[order[live]] >= l]
        if not len(live):
            break
        # suffixes of one number share enough words after the head
        run = np.concatenate(([0], np.cumsum(common < block.around - l)))[live]
        before = block.left_sums[order[live], l] ^ block.own[order[live]]
        by = np.argsort(before, kind="stable")
        p, beside = order[live[by]], before[by[1:]] == before[by[:-1]]
        same = np.flatnonzero(beside & (run[by[1:]] == run[by[:-1]]))
        for own, other in ((p[same], p[same + 1]), (p[same + 1], p[same])):
            new = least[own] > block.around
            least[own[new]] = l
            last_beside[own[new]] = other[new]
            most[own] = l
            first_beside[own] = other
        first = p[np.setdiff1d(np.arange(len(p)), same + 1, assume_unique=True)]
        seen.append((first[block.split[first] & (block.n_right[first] >= block.around - l)], l))
        # who shares these words before the head with no other shares no more of them either; other parts may
        alone = np.ones(len(p), bool)
        alone[1:] &= ~beside
        alone[:-1] &= ~beside
        stays = np.ones(len(p), bool)
        stays[by] = ~alone | block.split[p]
        live = live[stays]
    places = np.flatnonzero(most >= 0)
    for l, beside in ((most[places], first_beside[places]), (least[places], last_beside[places])):
        if block.slices(places, l, block.around - l) != block.slices(beside, l, block.around - l):
            return None
    return places, most[places], block.around - least[places], seen


_MATCHES = "row long, k long, start int, end int, code binary"


def _matches(min_words: int):
    head = head_words(min_words)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in _MATCHES.split(", ")]
        for block, (places, before, after, seen) in each_block(batches, head, WIDTH - 1, PLACES, matched):
            found = [(places, block.at[places] - before, block.at[places] + head + after, None)]
            found += [(p, block.at[p] - l, block.at[p] - l + min_words, block.digests(p, l)) for p, l in seen]
            for p, start, end, codes in found:
                if len(p):
                    code = pa.nulls(len(p), pa.binary()) if codes is None else pa.array(codes, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(block.row[p]), pa.array(block.k[p], mask=block.null[p]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), code], names)

    return run


def matches(rows: DataFrame, min_words: int = MIN_WORDS, part: int = PART) -> DataFrame:
    """row, k, start, end (words) of matches in :func:`document_rows`; they may overlap and repeat."""
    shared, looped = blocks(rows, retained(min_words), part)
    found = stored(shared.mapInArrow(_matches(min_words), _MATCHES), "matches", clean=True)
    # Split blocks: each part shows every window once; those that several parts show match too. Within its part a window's equals are found.
    shown = found.filter("code IS NOT NULL")
    again = stored(shown.groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("row", "start")).alias("a"), F.max(F.struct("row", "start")).alias("z")).filter("a < z").select("code", "count"), "repeated-windows", clean=True)
    across = spread_join(shown, again.select("code"), ["code"], again, "row", part)
    names = ["row", "k", "start", "end"]
    return found.filter("code IS NULL").select(*names).unionAll(across.select(*names)).distinct().unionAll(looped.filter(F.col("end") - F.col("start") - F.col("period") >= min_words).select(*names))  # a loop matches itself


def _merged(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        spans = list(listed_spans(batch["found"]))
        counts = [len(s) for s in spans], [sum(e - b for b, e in s) for s in spans]
        yield pa.RecordBatch.from_arrays([batch["k"], *(pa.array(c, pa.int64()) for c in counts), span_lists(spans)], ["doc_id", "n_spans", "n_repeated_words", "spans"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """doc_id, n_spans, n_repeated_words and spans (start and end in words) of each row with repeated passages.

    A passage of ``min_words`` words or more that stands twice, in two rows or
    in one, is found at both places; overlapping matches are joined. Words are
    separated by white space and compared as they are. Rows without such a
    passage give no row, so null, empty and shorter texts and an empty table
    give none. Repeated rows match each other, and each gives a row; null ids
    are as good as others. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = document_rows(docs, doc_id, text)
    # at most as many matches of a row as it has words
    found = matches(rows, min_words, part).groupBy("row").agg(F.first("k").alias("k"), F.collect_list(F.struct("start", "end")).alias("found"))
    return found.select("k", "found").mapInArrow(_merged, "doc_id long, n_spans long, n_repeated_words long, spans array<struct<start:int,end:int>>")


def listed_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_repeated_words, and the spans as text: ``start-end`` of each, with blanks between."""
    span = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return repeated_passages(docs.select("doc_id", "text")).withColumn("spans", F.array_join(span, " "))
