"""Operators do the whole job where tables are skewed, passages quoted in parts, and ids shared."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripweave.llm import chosen_path, mixing, rlz, sparse_suffix

from .conftest import prose


def test_mixing_keeps_what_the_targets_ask_for(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        lang = rng.choices(["en", "fr", "de", "es"], [0.5, 0.22, 0.25, 0.03])[0]
        rows.append((i, " ".join(lang + w for w in prose(rng, rng.randint(60, 120)).split()), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    labelled = docs.filter("doc_id < 800").select("text", F.col("lang").alias("domain"))
    tokens = lambda found: Counter(lang for _, t, lang in found for _ in t.split())
    there, kept = tokens(rows), tokens(map(tuple, mixing.thinned(docs, labelled, corpus_pipeline.MIXTURE).collect()))
    for domain, share in corpus_pipeline.MIXTURE.items():
        want = min(there[domain], share * sum(there.values()))
        assert abs(kept[domain] - want) < 0.1 * want, (domain, kept, there)


@pytest.mark.parametrize("part", [4096, 2])
def test_suffixes_find_all_partial_quotes_of_a_clause(spark, part):
    rng = random.Random(4)
    clause = prose(rng, 100).split()
    texts = []
    for _ in range(400):
        n = rng.randint(30, 60)
        s = rng.randint(0, 100 - n)
        texts.append([*prose(rng, rng.randint(5, 40)).split(), *clause[s : s + n], *prose(rng, rng.randint(5, 40)).split()])
    seen, covered = defaultdict(set), defaultdict(set)
    for i, words in enumerate(texts):
        for s in range(len(words) - 49):
            seen[tuple(words[s : s + 50])].add((i, s))
    for found in seen.values():
        for i, s in found if len(found) > 1 else ():
            covered[i].update(range(s, s + 50))
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: {w for s in r.spans for w in range(s.start, s.end)} for r in sparse_suffix.repeated_passages(docs, part=part).collect()}
    assert got == covered, (sum(map(len, covered.values())), sum(map(len, got.values())), len(covered), len(got))


def test_rows_of_one_id_are_told_apart_by_more_than_32_bits(spark):
    rng = random.Random(11)
    one, two = prose(rng, 60), prose(rng, 80)
    a, b = one + " a5670", two + " b23431"
    docs = spark.createDataFrame([(None, a), (None, b), (1, one), (2, two)], "doc_id long, text string")
    assert docs.filter("doc_id IS NULL").select(F.hash("text")).distinct().count() == 1  # equal in 32 bits
    assert {(r.n_words, r.n_removed, r.kept_text) for r in rlz.without_repeats(docs).filter("doc_id IS NULL").collect()} == {(61, 60, "a5670"), (81, 80, "b23431")}
    assert sorted((r.n_spans, r.n_repeated_words) for r in sparse_suffix.repeated_passages(docs).filter("doc_id IS NULL").collect()) == [(1, 60), (1, 80)]
    assert sorted(r.n_links for r in chosen_path.similarity_classes(docs).collect()) == [1, 1, 1, 1]
    left = chosen_path.without_near_copies(docs.filter("doc_id IS NULL OR doc_id = 2")).collect()
    assert {(r.doc_id, r.text) for r in left} == {(None, a), (2, two)} and len(left) == 2


def test_factors_are_the_longest_that_start_earlier(spark):
    """Every factor stands in its source, none could go on, and together they cover what brute force finds."""
    rng = random.Random(12)
    base = [prose(rng, 60).split() for _ in range(4)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(3):
            source, n = rng.choice(base), rng.randint(15, 45)
            s = rng.randint(0, len(source) - n)
            words += source[s : s + n] + prose(rng, rng.randint(0, 4)).split()
        texts.append(words)
    ids = [i if i % 9 else None for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(ids, texts)], "doc_id long, text string").repartition(3)
    at, order = defaultdict(set), lambda i: (i is None, i or 0)
    for i, w in zip(ids, texts):
        for s in range(len(w) - 19):
            at[tuple(w[s : s + 20])].add((order(i), s))
    for part in (4096, 2):
        for r in rlz.without_repeats(docs, part=part).collect():
            candidates = [w for i, w in zip(ids, texts) if i == r.doc_id and len(w) == r.n_words]
            matching = []
            for w in candidates:
                late = {s for s in range(len(w) - 19) if min(at[tuple(w[s : s + 20])]) < (order(r.doc_id), s)}
                kept = " ".join(x for j, x in enumerate(w) if not any(j - 19 <= s <= j for s in late))
                if kept == r.kept_text:
                    matching.append((w, late))
            assert matching
            w, late = matching[0]
            covered = {s for f in r.factors for s in range(f.start, f.end - 19)}
            assert covered == late
            for f in r.factors:
                assert (order(f.source_id), f.source_start) < (order(r.doc_id), f.start)
                assert any(v[f.source_start : f.source_start + f.end - f.start] == w[f.start : f.end] for i, v in zip(ids, texts) if i == f.source_id)


def test_copies_of_one_row_do_not_multiply_factors(spark):
    rng = random.Random(13)
    text = prose(rng, 60)
    docs = spark.createDataFrame([(1, text)] + [(None, text)] * 400 + [((1 << 63) - 1, text + " end")], "doc_id long, text string").repartition(4)
    for part in (4096, 16):
        got = rlz.without_repeats(docs, part=part).collect()
        assert len(got) == 402 and sum(r.n_removed for r in got) == 401 * 60
        assert {r.doc_id for r in got} == {1, None, (1 << 63) - 1} and max(len(r.factors) for r in got) <= 41
    found = sparse_suffix.repeated_passages(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter({1: 1, None: 400, (1 << 63) - 1: 1}) and {r.n_repeated_words for r in found} == {60}
    classes = chosen_path.similarity_classes(docs).collect()
    assert {(r.class_id, r.n_links) for r in classes} == {(1, 401)} and sum(r.kept for r in classes) == 1


def test_null_ids_are_drawn_row_by_row(spark):
    rng = random.Random(14)
    rows = [(None if i % 2 else i, " ".join("en" + w for w in prose(rng, 40).split()), "en") for i in range(400)]
    rows += [(None, " ".join("fr" + w for w in prose(rng, 40).split()), "fr") for _ in range(100)] + [(7, "ena enb enc " * 12, "en")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()
    labelled = docs.select("text", F.col("lang").alias("domain"))
    left = mixing.thinned(docs, labelled, {"en": 0.5, "fr": 0.5})
    null = left.filter("doc_id IS NULL AND lang = 'en'").count() / 200
    known = left.filter("doc_id IS NOT NULL AND doc_id <> 7").count() / 200
    copies = left.filter("doc_id = 7").count() / 200
    assert 0 < null < 1 and abs(null - known) < 0.2 and 0 < copies < 1
    assert left.filter("lang = 'fr'").count() > 85


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash that takes all words of one length for equal, blocks are compared once more by exact words."""
    import numpy as np

    from tripweave.llm import blocks

    rng = random.Random(15)
    texts = [prose(rng, 70).split() for _ in range(6)]
    texts += [texts[0][:40] + texts[1][30:], texts[2][10:65] + texts[3]]
    data = b" ".join(" ".join(t).encode() for t in texts)
    starts = blocks.word_starts(data)
    real = blocks.words_of
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    size, around = 6, 14
    rows = []
    for t, words in enumerate(texts):
        for at in range(around, len(words) - size - around, 7):
            rows.append((t, at, first[t] + at))
    import pyarrow as pa

    def table():
        lo = [at - around for _, at, _ in rows]
        hi = [at + size + around for _, at, _ in rows]
        words = [data[starts[g - around] : starts[g + size + around] - 1] for _, _, g in rows]
        n = len(rows)
        columns = {"key": pa.array([1] * n), "part": pa.array([0] * n, pa.int32()), "split": pa.array(np.zeros(n, bool)), "lo": pa.array(lo, pa.int32()), "at": pa.array([at for _, at, _ in rows], pa.int32()),
                   "hi": pa.array(hi, pa.int32()), "row": pa.array([t for t, _, _ in rows]), "k": pa.array([t for t, _, _ in rows]), "words": pa.array(words, pa.binary())}
        return pa.table(columns)

    def found():
        ((block, (factors, _)),) = blocks.each_block(iter(table().to_batches()), size, around, 1000, rlz.parsed)
        return sorted((int(p), int(b), int(a), block.slices(np.array([p]), b, a)) for x in factors for p, b, a in zip(*x[:3]))

    want = found()
    monkeypatch.setattr(blocks, "words_of", lambda text: (np.array([len(w) for w in text.split()], np.uint64) * np.uint64(2**40), None, None))
    assert found() == want and real is not blocks.words_of
