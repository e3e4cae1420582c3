"""Texts that repeat a few words on and on, alone and beside others, in the operators on repeated passages."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tripweave.llm import blocks, rlz, sparse_suffix
from tripweave.llm.common import words_of

SCHEMA = "doc_id long, text string"


def looping_documents():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    rows = [(1, prose(40) + ["a"] * 900 + prose(40)), (2, ["a"] * 60), (3, ["a", "b"] * 450 + prose(70)), (4, prose(30) + ["b", "a"] * 40)]
    cycle = prose(13)
    rows += [(5, cycle * 60), (6, prose(5) + cycle * 6 + prose(5)), (7, ["a"] * 400 + ["c"] * 400 + ["a"] * 400), (8, ["a", "a", "b"] * 300), (None, ["a"] * 700), (9, ["a"] * 1200)]
    rows += [(9, ["a"] * 1200), (10, prose(1) * 255), (11, prose(9) * 100), (12, ["b"] * 49), (13, ["b"] * 50), (14, ["b"] * 51)]
    return [(i, " ".join(w)) for i, w in rows]


def test_loops_are_what_repeats():
    for text, want in ((b"a " * 500, [(0, 500, 1)]), (b"x " + b"a b " * 300 + b"y", [(1, 601, 2)]), (b"a " * 256, []), (b"a " * 257, [(0, 257, 1)]), (b"", []), (b"a", [])):
        words, starts, ends = words_of(text)
        assert blocks.loops(words, text, starts, ends) == want


def plain(rows, least):
    """Of each row the words of windows that stand elsewhere, and those whose window starts earlier."""
    at = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        words = text.split()
        for p in range(len(words) - least + 1):
            at[tuple(words[p : p + least])].append((i is None, i or 0, p, n))
    again, later = defaultdict(set), defaultdict(set)
    for places in at.values():
        first = min(places)[:3]
        for none, i, p, n in places:
            if len(places) > 1:
                again[n].update(range(p, p + least))
            if (none, i, p) > first:
                later[n].update(range(p, p + least))
    return again, later


@pytest.mark.parametrize("part", [blocks.PART, 16])
def test_passages_and_factors_equal_plain_ones(spark, part):
    rows = looping_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    again, _ = plain(rows, 50)
    want = sorted((str(rows[n][0]), len(w)) for n, w in again.items())
    got = sparse_suffix.repeated_passages(docs, part=part).collect()
    assert sorted((str(r.doc_id), r.n_repeated_words) for r in got) == want
    assert all(sum(e - s for s, e in r.spans) == r.n_repeated_words for r in got)
    _, later = plain(rows, 20)
    left = rlz.without_repeats(docs, part=part).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in left) == sorted((str(i), len(later[n])) for n, (i, _) in enumerate(rows))
    texts = {r.doc_id: r.kept_text for r in left if r.doc_id != 9}
    for n, (i, text) in enumerate(rows):
        if i != 9:
            assert texts[i] == " ".join(w for p, w in enumerate(text.split()) if p not in later[n])


def test_a_long_text_of_one_word_is_one_factor_and_few_places(spark):
    docs = spark.createDataFrame([(1, "word " * 3_000_000), (2, "a word " * 500_000), (3, "word " * 100)], SCHEMA)
    found = {r.doc_id: r for r in sparse_suffix.repeated_passages(docs).collect()}
    assert [tuple(s) for s in found[1].spans] == [(0, 3_000_000)] and [tuple(s) for s in found[2].spans] == [(0, 1_000_000)] and found[3].n_repeated_words == 100
    left = {r.doc_id: r for r in rlz.without_repeats(docs).collect()}
    assert left[1].n_removed == 2_999_999 - 0 and left[1].kept_text == "word" and left[3].n_removed == 100 and left[2].n_removed == 999_998
    assert max(f.end - f.start for f in left[1].factors) == 2_999_999  # one factor, whose source is the text itself
    words, starts, ends = words_of(b"word " * 3_000_000)
    key, lo, at, hi = rlz.phrases()(words)
    kept = ~((lo >= 1) & (hi <= len(words)))
    assert len(key) > 2_000_000 and kept.sum() <= 2 and np.all(lo[kept] < 1)
