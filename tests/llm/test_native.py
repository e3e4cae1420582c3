"""Sharding, exact deduplication, quality rules and mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import content_sort, mixing, rules, sharding

from .conftest import prose

WHITE = re.compile(r"[\x20\x09-\x0D]")


def test_shards_hold_equal_bytes(spark, docs, rows):
    got = sharding.shard_documents(spark, docs, 5).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    even = sharding.shard_documents(spark, docs.filter("doc_id <> 13"), 5).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(even) == 5 and max(r.b for r in even) - min(r.b for r in even) < 0.02 * sum(r.b for r in even) / 5 + 64
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_slots_follow_the_key_alone(spark, docs):
    a = {r.doc_id: r.virtual_slot for r in sharding.with_slots(docs).collect() if r.doc_id is not None}
    b = {r.doc_id: r.virtual_slot for r in sharding.with_slots(docs.withColumn("text", F.lit("x"))).collect() if r.doc_id is not None}
    assert a == b


def test_the_map_is_versioned_and_edited(spark, docs):
    _, table = sharding.balanced_shards(docs.select("doc_id", "text"), 5)
    versions = {v: {r.virtual_slot: r.map_shard for r in table.filter(f"version = {v}").collect()} for v in (1, 2)}
    assert versions[1].keys() == versions[2].keys() == set(range(sharding.SLOTS))
    moved = [s for s in versions[1] if versions[1][s] != versions[2][s]]
    assert 0 < len(moved) < 100  # a few slots, not all


def test_sharding_of_odd_tables(spark, empty, clashing, rows):
    assert sharding.shard_documents(spark, empty).count() == 0
    placed, _ = sharding.balanced_shards(clashing, 200)
    assert placed.count() == len(rows)


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return groups


@pytest.mark.parametrize("frequent", [8, 2])
def test_exact_groups(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(content_sort, "FREQUENT", frequent)  # 2: nearly every group is split and merged again
    got = content_sort.content_groups(docs).collect()
    groups = expected_groups(rows)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        group = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(group)[3], len(group))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_without_copies_keeps_all_columns(clashing, rows, empty):
    left = content_sort.without_copies(clashing)
    assert left.columns == clashing.columns
    assert left.count() == len(expected_groups(rows))
    assert content_sort.without_copies(empty).count() == 0


def brute_measures(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_whole_texts(docs, rows, empty, clashing):
    got = rules.judged(docs).collect()
    want = Counter((i, *brute_measures(t or "")) for i, t, *_ in rows)
    assert Counter(tuple(r[:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.judged(empty).count() == 0 and rules.judged(clashing).count() == len(rows)


def test_rules_are_one_projection_without_python(docs):
    plan = rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


#: For each threshold a text that fails it alone, and one beside it that passes all.
DECIDED = {
    "length": ("ein Wort das " * 333_334, None),
    "word_length": (" ".join(f"{'x' * 24}{i:03d}" for i in range(30)), " ".join(f"{'x' * 15}{i:03d}" for i in range(30))),
    "symbols": (" ".join(f"word{i} #" for i in range(20)), " ".join(f"word{i}" + " #" * (i % 4 == 0) for i in range(20))),
    "stop_words": (" ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(58)) + " the and"),
    "duplicate_lines": ("\n".join(["one"] * 5 + [f"three{i} four{i} five{i}" for i in range(2)]), "\n".join(["one"] * 3 + [f"three{i} four{i} five{i}" for i in range(3)])),
    "ellipsis_lines": ("\n".join(f"a{i} b{i} c{i} ..." for i in range(4)), "\n".join(f"a{i} b{i} c{i}" + " ..." * (i % 2) for i in range(4))),
    "bullet_lines": ("\n".join(f"- alpha{i} beta{i} gamma{i}" for i in range(10)), "\n".join(f"{'-' * (i > 0)} alpha{i} beta{i} gamma{i}" for i in range(10))),
}


@pytest.mark.parametrize("name", [t.name for t in rules.THRESHOLDS])
def test_every_threshold_decides(spark, name):
    bad, good = DECIDED[name]
    if name == "length":  # without windows of five that come again
        bad = " ".join(f"w{i:x} the" for i in range(500_001))
        good = " ".join(f"w{i:x} the" for i in range(500_000))
    docs = spark.createDataFrame([(1, bad), (2, good)], "doc_id long, text string")
    without = tuple(t for t in rules.THRESHOLDS if t.name != name)
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert not got[1].base_failed and not got[1].kept and got[2].kept
    assert {r.doc_id: r.kept for r in rules.judged(docs, without).collect()} == {1: True, 2: True}


def test_repeated_and_null_ids_are_spread(spark):
    text = "some words " * 7
    rows = [(i, text) for i in range(10_000)] + [(None, text)] * 12_000 + [(5, text)] * 8_000 + [(7, text + str(i)) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed, table = sharding.balanced_shards(docs, 24)
    by = placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count("slot").alias("n"), F.min("slot").alias("least"), F.max("slot").alias("most")).collect()
    assert len(by) == 24 and max(r.b for r in by) - min(r.b for r in by) < 0.01 * sum(r.b for r in by) / 24
    assert all((r.least, r.most) == (0, r.n - 1) for r in by) and sum(r.n for r in by) == len(rows)
    largest = placed.groupBy("virtual_slot", "piece").count().agg(F.max("count")).first()[0]
    assert largest < len(rows) / 500  # no task of the window has a large part of the rows
    assert table.filter("version = 2").count() < 2 * sharding.SLOTS


def test_copies_with_one_id_are_split(spark):
    rows = [(None, "one text for all")] * 20_000 + [(i, f"text {i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = content_sort.frequent_texts(docs.select(F.xxhash64(content_sort.normalised()).alias("norm_hash")), len(rows)).collect()
    assert len(hot) == 1 and hot[0].parts > 500
    got = content_sort.content_groups(docs)
    assert got.filter("kept").count() == 20_001
    assert [tuple(r) for r in got.filter("doc_id IS NULL").select("keep_id", "group_size").distinct().collect()] == [(None, 20_000)]
    assert content_sort.without_copies(docs).count() == 20_001


def shares_of(rng, shares, sharp=0.7, n=4000):
    """Posteriors and tokens of made-up rows, ``shares`` of which belong mostly to each domain."""
    domain, k = rng.choice(len(shares), n, p=np.array(shares) / sum(shares)), len(shares)
    p = rng.dirichlet([0.3] * k, n) * (1 - sharp)
    p[np.arange(n), domain] += sharp
    return p, rng.integers(1, 2000, n).astype(float)


def brute_distance(p, t, targets, most, steps=20_000):
    """Squared distance, in shares of all tokens, that plain projected gradient descent on every rate comes to."""
    a, goal = (p * t[:, None]) / t.sum(), targets / t.sum()
    x, y, pace, length = np.ones(len(t)), np.ones(len(t)), 1.0, 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):  # with momentum, begun anew where it leads up
        new = np.clip(y - length * a @ (y @ a - goal), 0, most)
        if (y - new) @ (new - x) > 0:
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        x, y, pace = new, new + (pace - 1) / faster * (new - x), faster
    return float(((x @ a - goal) ** 2).sum())


@pytest.mark.parametrize(
    "shares, targets, most",
    [((0.90, 0.05, 0.04, 0.01), (0.1, 0.1, 0.1, 0.7), None), ((0.97, 0.01, 0.01, 0.01), (0.4, 0.2, 0.2, 0.2), None), ((0.9, 0.05, 0.04, 0.01), (0.1, 0.1, 0.1, 0.7), 1.0), ((0.6, 0.2, 0.1, 0.1), (0.6, 0.15, 0.15, 0.1), 1.0), ((0.5, 0.5), (0.0, 1.0), None)],
)
def test_rates_meet_the_first_order_condition(shares, targets, most):
    p, t = shares_of(np.random.default_rng(1), shares)
    goal, calls = np.array(targets) * t.sum(), []

    def at(x):
        calls.append(x)
        free = 1 - p @ x
        r = np.clip(free, 0, most)
        return float((t * r * (free - r / 2)).sum()), (t * r) @ p, (p * (t * ((free > 0) & (free < (most or np.inf))))[:, None]).T @ p

    x = mixing.solved(at, goal, t.sum())
    off = (at(x)[1] - goal) / t.sum()
    best = brute_distance(p, t, goal, most)
    assert float(off @ off) <= best + 1e-7 and len(calls) < 100
    if best < 1e-9:  # within reach: every domain is met
        assert np.abs(off).max() < 1e-4


def test_rates_meet_the_targets(spark):
    rng = random.Random(4)
    words = {d: [d + prose(rng, 1) for _ in range(50)] for d in ("en", "fr", "de", "es")}
    rows = [(i, " ".join(rng.choices(words[d], k=rng.randint(20, 200))), d) for i, d in enumerate(rng.choices(list(words), (8, 4, 2, 1), k=300))]
    rows += [(300 + i, " ".join(rng.choices(words["en"] + words["es"], k=80)), None) for i in range(20)]  # between two domains
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    weights = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
    got = mixing.mixed(df.select("doc_id", "text"), df.filter("domain IS NOT NULL").select("text", "domain"), weights).toPandas()
    p, t, x = np.array(got["posteriors"].tolist()), got["tokens"].to_numpy(float), got["rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (x >= 0).all()
    assert np.allclose((x * t) @ p / t.sum(), list(weights.values()), atol=1e-3)
    between = p[got["doc_id"] >= 300]
    assert (between[:, [0, 3]].mean(axis=0) > 0.2).all() and (between[:, [1, 2]] < 0.05).all()


def test_rates_come_as_near_as_they_can(docs, rows):
    labelled = docs.select("text", F.col("lang").alias("domain")).filter("domain IS NOT NULL AND text IS NOT NULL")
    weights = {"en": 0.1, "fr": 0.1, "de": 0.1, "es": 0.7}
    got = mixing.mixed(docs.select("doc_id", "text"), labelled, weights).toPandas()
    p, t, x = np.array(got["posteriors"].tolist()), got["tokens"].to_numpy(float), got["rate"].to_numpy()
    assert len(got) == len(rows) and (x >= 0).all()
    targets = np.array(list(weights.values())) * t.sum()
    off = ((x * t) @ p - targets) / t.sum()
    assert float(off @ off) <= brute_distance(p, t, targets, None) + 1e-7


def test_posteriors_equal_brute_force(spark, docs, rows):
    labelled = docs.filter("lang IS NOT NULL").select("text", F.col("lang").alias("domain"))
    domains = ["en", "fr", "de", "es"]
    weights, prior = mixing.log_weights(labelled, domains)
    got = {r.doc_id: r for r in mixing.with_posteriors(docs.select("doc_id", "text"), weights, prior).collect()}
    bucket = {r.w: r.id for r in docs.select(F.explode(F.filter(F.split(F.coalesce("text", F.lit("")), rules.SPACES), lambda w: w != "")).alias("w")).distinct().select("w", F.pmod(F.hash(F.lower("w")), F.lit(mixing.BUCKETS)).alias("id")).collect()}
    counts = np.ones((4, mixing.BUCKETS))
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    for i, t, lang, *_ in rows:
        for w in split(t) if lang else ():
            counts[domains.index(lang), bucket[w]] += 1
    logs, start = np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(counts.sum(axis=1) / counts.sum())
    for i, t, *_ in rows:
        words = split(t)
        e = start + mixing.SHARPNESS * (logs[:, [bucket[w] for w in words]].mean(axis=1) if words else 0)
        want = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert got[i].tokens == len(words) and np.allclose(got[i].posteriors, want, atol=1e-4)


def test_mixing_of_odd_tables(empty, docs, clashing, rows):
    labelled = docs.select("text", F.col("lang").alias("domain"))
    weights = {"en": 0.5, "fr": 0.5}
    assert mixing.mixed(empty.select("doc_id", "text"), labelled, weights).count() == 0
    assert mixing.mixed(docs.select("doc_id", "text"), labelled.limit(0), weights).count() == len(rows)
    assert mixing.mixed(clashing, labelled, weights).count() == len(rows)
    thinned = mixing.thinned(clashing, labelled, weights)
    assert thinned.columns == clashing.columns and 0 < thinned.count() <= len(rows)
