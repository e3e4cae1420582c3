"""Phrases, sketches and centroids against plain versions, with odd rows of every kind."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import centroids, fast_sketch, phrases
from tripweave.llm.common import mix

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# phrases


def plain_phrases(rows, max_n=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    best = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        best[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p, -a, x, y, n[lang], -s) for lang, found in best.items() for i, (s, a, _, p, x, y) in enumerate(sorted(found)[:top])}


def as_set(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("max_n, least, known", [(3, 2, 10**6), (4, 3, 0), (2, 2, 10**6)])
def test_phrases_equal_plain_counts(spark, docs, rows, monkeypatch, max_n, least, known):
    monkeypatch.setattr(phrases.phrase_counts, "__defaults__", (*phrases.phrase_counts.__defaults__[:-1], known))  # 0: nothing is ruled out by parts
    some = [r for r in rows if r[0] != 13]  # the plain version is slow on the very long one
    got = as_set(phrases.collocations(docs.filter("doc_id IS NULL OR doc_id <> 13"), max_n, least))
    assert got == plain_phrases(some, max_n, least) and len(got) > 50


def test_phrases_of_odd_texts(spark):
    text = ["The CAT\tsat.  the cat sat", "a b,a b;c", "É é É", None, "", " \t", "\n.,"] * 10 + ["x " * 50_000]
    rows = [(i, t, lang, None, None) for i, t in enumerate(text) for lang in ("en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, f int, phrase string")
    got = as_set(phrases.collocations(docs))
    assert got == plain_phrases(rows)
    assert ("und", "the cat sat") in {(r[0], r[2]) for r in got} and phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, top=1).count() == 2


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3 * 10**14, 3 * 10**14 + 1, 4 * 10**14)], "a long, l long, r long").withColumns({f"__{c}": F.col(c).cast("decimal(16,0)") for c in "alr"})
    assert counts.select(F.expr("(1000000 * __a * __a) div (__l * __r)")).first()[0] == 10**6 * 9 * 10**28 // ((3 * 10**14 + 1) * 4 * 10**14)


# sketches


def test_every_bin_is_filled_and_equal_bins_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 40_000):
        a = np.unique(mix(rng.integers(1, 2**62, n).astype(np.uint64)))
        least = fast_sketch.filled(a)
        assert (least < fast_sketch._EMPTY).all()
        turns = least >> np.uint64(48)
        if n == 1:  # bins that no round chose are filled in the second half, each by its own round
            late = np.flatnonzero(turns >= fast_sketch.BINS)
            assert len(late) and (turns[late] == late + fast_sketch.BINS).all()
    shares = []
    for _ in range(60):
        both, own, other = (mix(rng.integers(1, 2**62, n).astype(np.uint64)) for n in (170, 15, 15))
        x, y = (fast_sketch.sketch(np.unique(np.concatenate((both, z)))) for z in (own, other))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.85) < 0.015 and min(shares) * fast_sketch.BINS >= fast_sketch.SHARED


def test_rounds_at_once_change_nothing(monkeypatch):
    a = np.unique(mix(np.arange(1, 300, dtype=np.uint64)))
    want = fast_sketch.filled(a)
    for step in (1, 64, 1 << 18):
        monkeypatch.setattr(fast_sketch, "STEP", step if step > 1 else 37)
        assert (fast_sketch.filled(a) == want).all()


def plain_components(rows):
    sets = []
    for i, (k, text, *_) in enumerate(rows):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
        sets.append({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return Counter((rows[i][0], len(sets[i]), rows[min(g, key=key)][0]) for g in groups.values() for i in g)


def chained(rng):
    """Copies with one, two, three ... words changed: neighbours are linked, ends are not."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(24):
        out.append((1000 + i, " ".join(words).upper() if i % 2 else " ".join(words), "en", "s", 1))
        for j in range(3):
            words[(i * 8 + j * 60) % 200] = f"v{i}-{j}"
    return out


@pytest.mark.parametrize("leaf, weight", [(fast_sketch.LEAF, fast_sketch.WEIGHT), (4, 10**6), (3, 300), (2, 1)])
def test_components_equal_plain_ones(spark, rows, leaf, weight):
    """Small limits send groups past the hub, and their rest through pairs of parts."""
    every = rows + chained(random.Random(9))
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "k", "d", "cell", "kept", "component_id", "sketch")})
    got = fast_sketch.near_components(docs, leaf=leaf, weight=weight).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(every)
    kept = Counter(r.component_id for r in got if r.kept and r.n_shingles)
    assert max(kept.values()) == 1 and set(kept) == {r.component_id for r in got if r.n_shingles}
    assert all(r.kept for r in got if not r.n_shingles)


def test_near_copies_leave_one_row(spark, docs, empty):
    left = fast_sketch.without_near_copies(docs)
    assert left.columns == docs.columns and fast_sketch.without_near_copies(empty).count() == 0
    ids = Counter(r.doc_id for r in left.select("doc_id").collect())
    assert ids[3] == 1 and not ids[4] and not ids[6] and ids[0] == ids[1] == ids[2] == 1


# centroids


def plain_clusters(vectors, clusters=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    cents = [q for _, q in order[:clusters]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        which = [near(q)[1] for _, q in kept]
        for k in range(len(cents)):
            mine = [q for (_, q), w in zip(kept, which) if w == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, *near(q)) for i, q in kept]
    total = Counter()
    for _, d, k in final:
        total[k] += d
    return Counter((i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in final)


def odd_vectors():
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    out = [(i, [x * (1 + i % 3) + rng.gauss(0, 0.2) for x in middle[i % 6]]) for i in range(150)]
    out += [(200 + i, out[i][1]) for i in range(20)] + [out[3], out[3], (None, out[5][1]), (None, [0.0] * 64)]  # copies, repeated rows, ids that are null
    out += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [math.nan] * 64), (306, [math.inf] * 64), (307, [3e38] * 64), (308, [1e6, -1e6] * 32)]
    return out


VECTORS = "vec_id long, embedding array<float>, cluster string, q int"


def test_clusters_equal_plain_ones(spark):
    rows = odd_vectors()
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(4)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = Counter(tuple(r) for r in centroids.clustered(vectors).collect())
    assert got == plain_clusters(f32)
    assert Counter(tuple(r) for r in centroids.clustered(vectors.limit(0)).collect()) == Counter()
    few = vectors.filter("vec_id < 5")
    assert Counter(tuple(r) for r in centroids.clustered(few).collect()) == plain_clusters([r for r in f32 if r[0] is not None and r[0] < 5])


def test_annulus_finds_the_nearest_with_ties_and_compares_few():
    rng = np.random.default_rng(2)
    cents = (rng.integers(-50, 50, (40, 8)) * np.arange(1, 41)[:, None]).astype(np.int64)
    cents[7], cents[21] = cents[3], -cents[20]  # equal ones, and equal norms
    q = np.concatenate((cents, rng.integers(-900, 900, (500, 8)), np.zeros((1, 8), np.int64), (cents[20] + cents[21])[None, :]))
    d = ((q[:, None, :] - cents[None]) ** 2).sum(axis=2)
    for start in (None, rng.integers(0, 40, len(q)), d.argmin(axis=1)):
        which, best, compared = centroids.Annuli(cents).nearest(q, start)
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    near = np.repeat(cents, 20, axis=0) + rng.integers(-2, 3, (800, 8))
    _, _, compared = centroids.Annuli(cents).nearest(near, np.repeat(np.arange(40), 20))
    assert compared < 800 * 40 / 4  # from last round's centroid most others are outside the annulus


def test_means_are_floors_and_empty_clusters_stay(spark):
    q = lambda *x: np.array(x, np.int32).tobytes()
    assigned = spark.createDataFrame([(q(-3, 5), 0), (q(-4, 6), 0), (q(7, 7), 2)], "q binary, cluster int")
    assert centroids.moved(assigned, np.array([[9, 9], [1, 2], [0, 0]])).tolist() == [[-4, 5], [1, 2], [7, 7]]
