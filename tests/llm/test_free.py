"""URL filter, substring and near-duplicate operators, classifier and encoding against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import bpe, chosen_path, ordinal, rlz, sparse_suffix, url_filter
from tripweave.llm.components import components

from .conftest import prose


def words_of(t):
    return (t or "").encode().split()


def test_rlz_removes_what_starts_earlier(docs, rows):
    def brute():
        seen = {}
        windows = []
        for place, (i, t, *_) in enumerate(rows):
            w, k = words_of(t), math.inf if i is None else i
            for s in range(len(w) - 19):
                gram = tuple(w[s : s + 20])
                windows.append((place, k, s, gram))
                seen[gram] = min(seen.get(gram, (math.inf, math.inf)), (k, s))
        gone = defaultdict(set)
        for place, k, s, gram in windows:
            if seen[gram] < (k, s):
                gone[place].update(range(s, s + 20))
        out = Counter()
        for place, (i, t, *_) in enumerate(rows):
            w = words_of(t)
            kept = b" ".join(x for j, x in enumerate(w) if j not in gone[place])
            out[i, len(w), len(gone[place]), hashlib.sha256(kept).hexdigest()] += 1
        return out

    want = brute()
    assert sum(n for (_, _, removed, _), n in want.items() if removed)
    assert Counter(tuple(r) for r in rlz.digests(docs).collect()) == want
    # with every block split into parts
    split = rlz.without_repeats(docs, part=1).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in split) == want


def test_rlz_of_odd_tables(empty, clashing, rows):
    assert rlz.digests(empty).count() == 0
    assert rlz.without_repeats(clashing).count() == len(rows)


@pytest.mark.parametrize("part", [4096, 1])
def test_suffixes_find_every_long_passage(docs, rows, empty, clashing, part):
    seen = defaultdict(set)
    for place, (i, t, *_) in enumerate(rows):
        w = words_of(t)
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add((place, s))
    covered = defaultdict(set)
    for found in seen.values():
        if len(found) > 1:
            for place, s in found:
                covered[place].update(range(s, s + 50))
    got = sparse_suffix.repeated_passages(docs, part=part).collect()
    assert Counter((r.doc_id, r.n_repeated_words) for r in got) == Counter((rows[place][0], len(c)) for place, c in covered.items())
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        assert spans == sorted(spans) and all(e - s >= 50 for s, e in spans)
    assert sparse_suffix.repeated_passages(empty).count() == 0
    assert sparse_suffix.repeated_passages(clashing).count() == len(got)


def shingle_set(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either:
                links[a].add(b)
                links[b].add(a)
    label = list(range(len(rows)))
    for start in range(len(rows)):
        todo, group = [start], {start}
        while todo:
            for x in links[todo.pop()] - group:
                group.add(x)
                todo.append(x)
        label[start] = min((math.inf if rows[x][0] is None else rows[x][0]) for x in group)
    return links, label


def test_suffixes_are_sorted_by_their_words():
    """The order of suffixes and the common prefixes of neighbours, within parts, against plain lists of words."""
    import numpy as np
    import pyarrow as pa

    from tripweave.llm.blocks import Block, words_of as hashes

    rng = random.Random(5)
    around, rows = 6, []
    for part in (0, 1):
        for place in range(60):
            left, right = ([rng.choice("ab") for _ in range(rng.randrange(around + 1))] for _ in range(2))
            rows.append((part, place, left, right))
    n = len(rows)
    lo, at = np.zeros(n, np.int32), np.array([len(left) for _, _, left, _ in rows], np.int32)
    hi = at + 2 + np.array([len(right) for *_, right in rows], np.int32)
    columns = {"key": pa.array([9] * n), "part": pa.array([p for p, *_ in rows], pa.int32()), "split": pa.array(np.zeros(n, bool)), "lo": pa.array(lo), "at": pa.array(at), "hi": pa.array(hi),
               "row": pa.array([i for _, i, *_ in rows]), "k": pa.array([i for _, i, *_ in rows]), "words": pa.array([" ".join([*left, "h", "h", *right]).encode() for *_, left, right in rows], pa.binary())}
    block = Block(pa.table(columns), 2, around)
    order, common = sparse_suffix.suffix_order(block)
    code = {w: int(hashes(w.encode())[0][0] | np.uint64(1)) for w in "ab"}
    sorted_parts = [[[code[w] for w in rows[i][3]] for i in order.tolist() if rows[i][0] == p] for p in (0, 1)]
    assert all(x == sorted(x) for x in sorted_parts) and sorted(order.tolist()) == list(range(n))
    assert (common == -1).sum() == 1
    for i, j, c in zip(order[:-1].tolist(), order[1:].tolist(), common.tolist()):
        if c >= 0:
            pairs = list(zip(rows[i][3], rows[j][3]))
            assert c == next((m for m, (x, y) in enumerate(pairs) if x != y), len(pairs))
    # a suffix matches if some other of its part has as many words before and after the head in common as a passage needs
    places, before, after, _ = sparse_suffix.matched(block)
    got = dict(zip(places.tolist(), zip(before.tolist(), after.tolist())))

    def alike(x, y):
        return next((m for m, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

    for i, (part, _, left, right) in enumerate(rows):
        met = [(alike(left[::-1], y[2][::-1]), alike(right, y[3])) for j, y in enumerate(rows) if j != i and y[0] == part]
        met = [(l, r) for l, r in met if l + r >= around]
        assert got.get(i) == ((max(l for l, _ in met), max(r for _, r in met)) if met else None)


@pytest.mark.parametrize(("leaf", "weight"), [(4096, 8_000_000), (3, 8_000_000), (4096, 400)])
def test_chosen_paths_lose_no_link(docs, rows, monkeypatch, leaf, weight):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)  # 3: buckets are split along paths, and at last into pairs of parts
    monkeypatch.setattr(chosen_path, "WEIGHT", weight)  # 400: buckets of long texts are dealt into pairs of parts
    monkeypatch.setattr(chosen_path.all_leaves, "__defaults__", (leaf,))
    links, label = brute_classes(rows)
    want = Counter((i, None if label[p] == math.inf else label[p], len(links[p])) for p, (i, *_) in enumerate(rows))
    got = chosen_path.similarity_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert Counter(r.class_id for r in got if r.kept) == Counter({r.class_id for r in got})  # one row of each class


def test_near_copies_of_odd_tables(empty, clashing):
    assert chosen_path.similarity_classes(empty).count() == 0
    left = chosen_path.without_near_copies(clashing)
    assert left.columns == clashing.columns and left.count() < clashing.count()


def test_recall_decides_the_runs():
    assert chosen_path.runs_for(1) < chosen_path.runs_for(2) < chosen_path.runs_for(4)
    assert 1 - (1 - 0.8**3) ** chosen_path.runs_for(3) >= chosen_path.RECALL


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


URLS = [
    (1, "http://www.cheappills.example.com/buy?x=1"), (2, "https://a.EXAMPLE.org/es/1"), (3, "https://example.org/en/12#a"), (4, "http://x.org"), (5, "http://x.org/"),
    (6, None), (7, "no scheme"), (8, "http://b.com/de/7"), (9, "http://cheapbets.net/"), (10, "http://citylibrary.net/news"), (11, "http://notexample.org/es/"), (12, "http:///path"),
    (13, "http://" + "x" * 300 + ".net/"), (14, "http://b.com/fr/a://b"), (1, "http://www.cheappills.example.com/buy?x=1"), (15, "http://caf\u00e9bleu.net/"), (None, "http://citylibrary.net/news"),
    ((1 << 62) + 1, "http://x.org/"),
]
#: Pages that a rule judges, from which the words are learned.
TAUGHT = [
    *[(100 + i, f"http://cheappills{'x' * (i % 2)}.com/de/bets") for i in range(6)], *[(200 + i, f"http://citylibrary.org/news/{i}") for i in range(6)], (300, "http://freebets.com/de/cheap"), (301, "http://lib.org/city"),
]
HTML = "<p>Cheap pills and free bets; the city library. Caf\u00e9 bleu.</p><script>var casino = 1;</script>"


def url_pages(spark, rows):
    data = [(i, u, HTML if n % 2 else None, 1, "x") for n, (i, u) in enumerate(rows)]
    return spark.createDataFrame(data, "page_id long, url string, html string, count int, words string").repartition(3)


def test_urls_meet_rules_and_words(spark):
    pages = url_pages(spark, URLS + TAUGHT)
    rows = url_filter.judged_urls(pages).collect()
    got = {r.page_id: r for r in rows}
    assert Counter(r.page_id for r in rows) == Counter(i for i, _ in URLS + TAUGHT)
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[3].rule, got[3].verdict) == ("example.org/en/1", "block") and got[4].rule is None and got[5].rule == "org/"
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and got[6].words == []
    assert got[8].rule == "com/de/" and got[11].rule == "org/" and (got[12].host, got[12].path) == ("", "/path") and got[14].rule == "com/fr/"
    assert got[1].words[:3] == ["www", "cheap", "pills"] and got[15].words == ["caf\u00e9", "bleu", "net"] and got[13].words[0].startswith("x")
    assert got[9].rule is None and got[9].verdict == "block" and got[10].rule is None and got[10].verdict == "allow"


def test_bayes_equals_brute_force(spark):
    """The score from the counts of words of all pages that a rule judges, added up anew."""
    rows = url_filter.judged_urls(url_pages(spark, URLS + TAUGHT)).collect()
    taught = [r for r in rows if r.rule is not None]
    own = {"org", "example", "es", "en", "com", "fr", "de"}  # what the rules are made of
    words = {v: Counter(w for r in taught if r.verdict == v for w in r.words if w not in own) for v in ("block", "allow")}
    known = set(words["block"]) | set(words["allow"])
    n = {v: sum(c.values()) + len(known) for v, c in words.items()}
    prior = math.log((sum(r.verdict == "block" for r in taught) + 1) / (sum(r.verdict == "allow" for r in taught) + 1))
    for r in rows:
        want = prior + sum(math.log((words["block"][w] + 1) / n["block"]) - math.log((words["allow"][w] + 1) / n["allow"]) for w in r.words if w in known)
        assert r.score == pytest.approx(want, abs=2e-6)
        assert r.rule is not None or r.verdict == ("block" if want > 1e-9 else "allow")


def test_urls_of_odd_tables(spark):
    assert url_filter.judged_urls(url_pages(spark, URLS).limit(0)).count() == 0
    unruled = url_filter.judged_urls(url_pages(spark, URLS), ()).collect()
    assert {(r.rule, r.verdict, r.score) for r in unruled} == {(None, "allow", 0.0)}
    hot = url_filter.judged_urls(url_pages(spark, [(i, "http://citylibrary.org/a") for i in range(5000)] + URLS)).groupBy("verdict").count().collect()
    assert sum(r["count"] for r in hot) == 5000 + len(URLS)


def test_urls_learn_from_what_pages_say(spark):
    """A teacher of labelled texts labels pages, the urls' words learn from them, and pages held out are judged by their urls alone."""
    rng = random.Random(3)
    fair, foul = ["river", "stone", "meadow", "garden", "letter", "window"], ["scum", "moron", "trash", "idiot"]
    prose = lambda bad: " ".join(rng.choice(foul if bad and rng.random() < 0.4 else fair) for _ in range(30))
    docs = spark.createDataFrame([(i, prose(i % 3 == 0)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    teacher = ordinal.trained(docs, labels)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = ("moronscum" if bad else "rivergarden") + rng.choice([".info", ".net"])
        rows.append((i, f"http://{host}/{'trash' if bad else 'letter'}/{i}", f"<p>{prose(bad)}</p>"))
    rows += [(403 + i, "http://stonewindow.info/", f"<p>{prose(True)}</p>") for i in range(5)]  # one host alone teaches nothing of its own words
    rows += [(400, "http://trashmoron.net/x", None), (401, "http://gardenstone.net/x", ""), (402, None, f"<p>{prose(True)}</p>"), (None, "http://moronscum.org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("label", F.lit("clash")).repartition(3)
    named = pages.select("page_id", "url", "html", F.col("page_id").alias("row")).filter("page_id < 402")
    label = {r.page_id: r.label for r in url_filter.taught(named, teacher).collect()}
    assert all(label[i] == ("block" if i % 4 == 0 else "allow") for i in range(400)) and label[400] is label[401] is None
    got = {r.page_id: r for r in url_filter.judged_urls(pages, teacher=teacher).collect()}
    assert len(got) == len(rows) and got[403].words[:2] == ["stone", "window"] and got[403].verdict == "allow"
    assert all(got[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert got[400].words[:2] == ["trash", "moron"] and got[400].verdict == "block" and got[401].verdict == "allow"
    assert (got[None].rule, got[None].verdict) == ("org/", "allow") and got[None].score > 0  # the rule decides
    # held out: no page judged wrongly, whatever rules say of it
    found = url_filter.held_out(pages, teacher)
    assert found["block_allow"] <= 1 and found["allow_block"] == 0 and found["block_block"] > 10 and found["allow_allow"] > 30
    assert url_filter.judged_urls(pages.limit(0), teacher=teacher).count() == 0


def test_viterbi_finds_the_likeliest_split():
    counts = {"cheap": 5, "pills": 4, "he": 50, "a": 60, "pill": 6, "s": 3}
    total = 200

    def cost(w):
        return -math.log(counts[w] / (total + 1)) if w in counts else math.log(total + 1) + (len(w) - 1) * math.log(10)

    def splits(x):
        return [[x]] + [[x[:i], *r] for i in range(1, len(x)) for r in splits(x[i:])]

    for label in ("cheappills", "heapills", "acheap", "zzz", "qcheapqq"):
        got = url_filter.segmented(label, counts, total)
        assert "".join(got) == label and sum(map(cost, got)) == pytest.approx(min(sum(map(cost, s)) for s in splits(label)))


def test_ordinal_gradient_finds_ordered_grades():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(3))
        rows.append(np.unique(np.concatenate((rng.integers(100, 3000, 40), [g] * (rng.random() < 0.95)))).astype(np.int32))
        grades.append(g)
    m = ordinal.fit(rows[:1000], np.array(grades[:1000]))
    assert (np.diff(m.thresholds) > 0).all()
    tail = m.tail(np.array([m.score(r) for r in rows[1000:]]))
    assert ((tail[:, 1] <= tail[:, 0]).all()) and np.mean(np.array(grades[1000:]) == (tail > 0.5).sum(axis=1)) > 0.85


def test_grades_on_held_out_documents(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        kind = i % 3
        text = prose(rng, 80)
        text = text.replace(" ", " vilword ", 3) if kind == 0 else " ".join([text.split()[0]] * 80) if kind == 1 else text
        data.append((i, text, int(kind != 1), int(kind == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")
    model = ordinal.trained(df, df.filter("doc_id < 600").select("doc_id", "quality", "toxic"))
    got = ordinal.scored(df.filter("doc_id >= 600").select("doc_id", "text"), model).collect()
    right = sum((r.tail_probability >= ordinal.KEEP_FROM) == (r.doc_id % 3 == 2) for r in got)
    assert right >= 0.97 * len(got)


def test_only_telling_features_come_to_the_driver(spark):
    """The model from executors' counts is that of all rows at once; of a labelled id that comes often all rows count, within the limit."""
    rng = random.Random(6)
    data = [(i, prose(rng, 60) + (" vilword" if i % 3 == 0 else ""), 1, int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int").repartition(3)
    features = ordinal.Features()
    want = ordinal.fit([features(t) for _, t, *_ in data], np.array([0 if toxic else 2 for *_, toxic in data]))
    got = ordinal.trained(df, df)
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.thresholds, want.thresholds, atol=1e-4)
    often = df.unionAll(df.filter("doc_id = 3").crossJoin(spark.range(300)).drop("id"))
    assert len(ordinal.trained(often, df, limit=450).thresholds) == ordinal.GRADES - 1


def test_classifier_on_odd_tables(spark, docs, empty, clashing, rows):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = ordinal.quality_grades(docs, labels)
    assert got.count() == len(rows) and got.filter("tail_probability IS NULL OR expected_grade IS NULL").count() == 0
    assert ordinal.quality_grades(empty, labels).count() == 0
    assert ordinal.quality_grades(docs, labels.limit(0)).count() == len(rows)
    scored = ordinal.scored(clashing, ordinal.fit([], np.empty(0, int)))
    assert scored.count() == len(rows) and set(scored.columns) == {*clashing.columns, "expected_grade", "tail_probability"}


def test_encoding_of_odd_tables(spark, clashing, rows, monkeypatch):
    assert bpe.encoded_digests(clashing).count() == len(rows)
    large = spark.createDataFrame([((1 << 62) + 1, "text"), (None, "text")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in bpe.encoded_digests(large).collect()} == {(1 << 62) + 1, None}
    codec = bpe.Codec(bpe._content(None), border_bits=5)
    monkeypatch.setattr(bpe.Codec, "repaired", lambda *a: None)  # a text whose chunks do not join is encoded whole
    text = prose(random.Random(8), 300)
    assert codec.encode(text) == codec.library.encode(text, add_special_tokens=False).ids


def test_encoding_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_tokenizer())

    def want(t):
        ids = library.encode(t, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(tuple(r) for r in bpe.encoded_digests(docs).collect()) == Counter((i, *want(t or "")) for i, t, *_ in rows)
    ids = {r.doc_id: r.ids for r in bpe.encoded(docs.filter("doc_id = 3")).collect()}
    assert ids[3] == library.encode(rows[4][1], add_special_tokens=False).ids
    assert bpe.encoded_digests(empty).count() == 0


def test_chunks_are_encoded_once_and_joined_exactly():
    codec = bpe.Codec(bpe._content(None), border_bits=5, cache_bytes=1 << 16)
    rng = random.Random(2)
    shared = prose(rng, 400)
    for _ in range(20):
        text = prose(rng, 50) + " " + shared + rng.choice(["\n\n", "  ", " "]) + prose(rng, 30)
        assert codec.encode(text) == codec.library.encode(text, add_special_tokens=False).ids
    calls = []
    inner, codec.ids = codec.ids, lambda part: calls.append(part) or inner(part)
    before = len(codec.cache)
    codec.encode(prose(rng, 50) + " " + shared)
    assert len(codec.cache) - before < 30  # most chunks of the shared passage were there
