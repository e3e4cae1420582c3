"""Every stage of the pipeline against a brute-force version, on its own input."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tripweave.llm import bpe

from .conftest import SCHEMA, prose
from .test_free import brute_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(["en", "en", "fr", "de", "es"])
        text = " ".join(lang + w for w in prose(rng, rng.randint(60, 120)).split())
        kind = i % 10
        if kind == 0:
            text = text.replace(" ", " vilword ", 4)
        elif kind == 1:
            text = " ".join([text.split()[0]] * 90)
        rows.append((i, text, lang, "s", len(text)))
        if i < 400:
            labels.append((i, int(kind != 1), int(kind == 0)))
    good = [r for r in rows if r[0] % 10 > 1]
    rows += [(1000 + n, r[1].replace(" ", "  "), r[2], "s", 1) for n, r in enumerate(good[:40])]
    rows += [(2000 + n, " ".join(r[1].split()[:-1] + ["other"]), r[2], "s", 1) for n, r in enumerate(good[30:70])]
    rows += [rows[5], (None, prose(rng, 80), "en", None, None), (3000, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        after = [tuple(r) for r in out.collect()]
        assert not Counter(after) - Counter(before)
        kept[name] = before, after
        docs = spark.createDataFrame(after, SCHEMA).repartition(2)
    before, after = kept["quality"]
    for kind, least, most in ((0, 0.0, 0.05), (1, 0.0, 0.05), (5, 0.97, 1.0)):
        rows = [r for r in before if r[0] is not None and r[0] < 600 and r[0] % 10 == kind]
        assert least <= sum(r in after for r in rows) / len(rows) <= most
    before, after = kept["exact_dedup"]
    strip = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
    best = {}
    for r in before:
        best[strip(r)] = min(best.get(strip(r), (1, 0, 0, 0)), (-len(r[1] or ""), r[0] is None, r[0] or 0, r))
    assert Counter(after) == Counter(b[3] for b in best.values())
    before, after = kept["near_dedup"]
    _, label = brute_classes(before)
    assert {r[0] for r in after} == {None if x == float("inf") else x for x in label} and len(after) == len(set(label))
    assert len(before) - len(after) >= 30
    before, after = kept["mixing"]
    tokens = Counter()
    for r in after:
        tokens[r[2]] += len((r[1] or "").split())
    total = sum(tokens.values())
    assert len(after) > 0.3 * len(before) and all(abs(tokens[d] / total - w) < 0.08 for d, w in corpus_pipeline.MIXTURE.items())
    codec = bpe.Codec(bpe._content(None))
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()

    def digest(t):
        ids = codec.library.encode(t, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(tuple(r) for r in got) == Counter((r[0], *digest(r[1] or "")) for r in after)


def test_run_ends_with_the_encoding(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < got.count() < 640


def test_run_over_odd_tables(spark, folder, tmp_path):
    """Empty tables give no rows; further columns, named as stages name theirs, change nothing."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "k", "z", "tokens", "posteriors", "__row", "kept", "tail_probability", "rate", "d")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and 0 < out.count() <= wide.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == wide.count()
