"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words, shared by all grades, and ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - score). The expected grade
and the tail probability P(grade >= k) select documents.

The model is fitted on a bounded sample of the labelled rows; scoring reads
every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, text_of

#: Hashed words are dealt into so many weights; a weight for each step of each measure of style follows.
BUCKETS = 1 << 18
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
MEASURES = 6
STYLE = MEASURES * (len(STEPS) + 1)
#: Labelled rows, at most, that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
#: Documents are kept whose P(good) is at least this.
KEEP_FROM = 0.5

_SEPARATORS = bytes(range(33)) + b"!\"'(),-./:;?[]_`{}\x7f"
#: ASCII letters lower-cased, punctuation turned into spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SEPARATORS))


class Features:
    """Sparse features of a text: the weights that its hashed words and its steps of style have."""

    def __init__(self, limit: int = 500_000):
        from zlib import crc32

        self.known: dict[bytes, int] = {}
        self.limit, self.hash = limit, crc32

    def __call__(self, text: str) -> np.ndarray:
        data = text.encode()
        words = data.translate(_FOLD).split()
        known, distinct = self.known, set(words)
        for w in distinct:
            if w not in known:
                known[w] = self.hash(w) % BUCKETS
        ids = np.unique(np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct)))
        if len(known) > self.limit:
            known.clear()
        n = max(1, len(words))
        letters = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        lines = [x for x in data.split(b"\n") if x.strip()]
        measures = (
            1 / n,
            1 - min(1.0, len(distinct) / n**0.8),  # words that come again
            letters[list(b"#*$%&|<>")].sum() / n,
            letters[ord("!")] / n,
            letters[65:91].sum() / max(1, letters[65:91].sum() + letters[97:123].sum()),
            1 - len(set(lines)) / max(1, len(lines)),
        )
        style = BUCKETS + np.searchsorted(STEPS, measures, "right") + np.arange(MEASURES) * (len(STEPS) + 1)
        return np.concatenate((ids, style)).astype(np.int32)


class Model(NamedTuple):
    """``weights``: of hashed words, then of style; ``thresholds``: rising, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum(dtype=np.float64))

    def tail(self, scores: np.ndarray) -> np.ndarray:
        """Columns k = 1, 2, ...: P(grade >= k)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def telling(counts: np.ndarray, rows_of: np.ndarray, seen: int = 5, z: float = 5.0) -> np.ndarray:
    """The features that at least ``seen`` rows have and some grade has z standard deviations more or less often than
    chance; ``counts[g, f]``: rows of grade g with feature f, ``rows_of[g]``: rows of grade g."""
    n = rows_of.sum()
    share = rows_of / max(1, n)
    total = counts.sum(axis=0)
    expected = share[:, None] * total[None, :]
    spread = np.sqrt(np.maximum(expected * (1 - share)[:, None], 1e-9))
    return np.flatnonzero((total >= seen) & (total < n) & (np.abs(counts - expected) >= z * spread).any(axis=0))


def counted(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    """Rows of each grade that have each feature; a row has a feature once."""
    counts = np.zeros((n_grades, BUCKETS + STYLE), np.int64)
    for r, g in zip(rows, grades):
        counts[g, r] += 1
    return counts


def fit(rows: list[np.ndarray], grades: np.ndarray, used: np.ndarray | None = None, n_grades: int = GRADES, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, balance: float = 0.25) -> Model:
    """Maximise the penalised likelihood by Adam over the whole sample; only the features ``used``, or the telling ones, get a weight."""
    n = len(rows)
    if not n:
        return Model(np.zeros(BUCKETS + STYLE, np.float32), np.arange(n_grades - 1, dtype=float))
    if used is None:
        used = telling(counted(rows, grades, n_grades), np.bincount(grades, minlength=n_grades))
    column = np.concatenate(rows)
    row_of = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    place = np.full(BUCKETS + STYLE, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    column = place[column]
    row_of, column = row_of[column >= 0], column[column >= 0]
    # balance 0: each row counts alike; 1: each grade does
    weight = np.maximum(np.bincount(grades, minlength=n_grades), 1)[grades].astype(float) ** -balance
    weight /= weight.sum()
    w, t, gap = np.zeros(len(used)), np.zeros(1), np.zeros(n_grades - 2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t, gap)]
    for step in range(1, steps + 1):
        thresholds = t[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
        s = np.bincount(row_of, w[column], minlength=n)
        edge = np.concatenate(([-np.inf], thresholds, [np.inf]))
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(-(edge[grades + 1] - s)))
            lower = 1 / (1 + np.exp(-(edge[grades] - s)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = weight * (du - dl)  # of the loss by the score
        dw = np.bincount(column, ds[row_of], minlength=len(used)) + decay * w
        by = np.array([(weight * (dl * (grades == k + 1) - du * (grades == k))).sum() for k in range(n_grades - 1)])
        dgap = np.array([by[k + 1 :].sum() * np.exp(gap[k]) for k in range(n_grades - 2)])
        for x, g, (m, v) in zip((w, t, gap), (dw, np.array([by.sum()]), dgap), state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(BUCKETS + STYLE, np.float32)
    weights[used] = w
    return Model(weights, t[0] + np.concatenate(([0.0], np.cumsum(np.exp(gap)))))


def grade_of_labels() -> Column:
    """The graded rating that quality (0 or 1) and toxic (0 or 1) amount to."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)


def graded_sample(labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and grade of ``limit`` labelled ids at most, chosen by a hash; rows without id or labels are left out, and of several ratings of an id the lowest counts."""
    rated = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min(grade_of_labels()).alias("grade"))
    share = min(1.0, 0.97 * limit / max(1, labels.count()))  # so that the limit hardly ever cuts
    return rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(limit)


def trained(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, text: str = "text") -> Model:
    """The model fitted on at most ``limit`` labelled rows (whole texts); a null text counts as empty.

    Features are counted on the executors; the driver sees three numbers of a
    feature, and of the rows only their telling features. Rows of an id that
    comes more than once are all labelled alike, within ``limit``. Without
    labelled rows all weights are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def featurised(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in batches:
            ids = pa.array([features(t) for t in batch["t"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], ids], ["doc_id", "grade", "ids"])

    rated = graded_sample(labels, limit)
    # at most ``limit`` rows of two numbers: a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t")).join(F.broadcast(rated), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "t")
    sample = stored(rows.mapInArrow(featurised, "doc_id long, grade int, ids array<int>").limit(limit), "graded-features")
    rows_of, counts = np.zeros(GRADES, np.int64), np.zeros((GRADES, BUCKETS + STYLE), np.int64)
    for r in sample.groupBy("grade").count().collect():
        rows_of[r["grade"]] = r["count"]
    found = sample.select("grade", F.explode("ids").alias("id")).groupBy("grade", "id").count().toArrow()  # at most GRADES rows a feature
    counts[found["grade"].to_numpy(), found["id"].to_numpy()] = found["count"].to_numpy()
    used = telling(counts, rows_of)
    shared = spark.sparkContext.broadcast(used)

    def narrowed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.zeros(BUCKETS + STYLE, bool)
        known[shared.value] = True
        for batch in batches:
            ids = batch["ids"].flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch["ids"].offsets.to_numpy()))
            ends = np.cumsum(np.bincount(row[known[ids]], minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids[known[ids]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], lists], ["doc_id", "grade", "ids"])

    got = sample.mapInArrow(narrowed, "doc_id long, grade int, ids array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit([], np.empty(0, np.int64))
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    ends, ids = got["ids"].combine_chunks().offsets.to_numpy(), got["ids"].combine_chunks().values.to_numpy()
    return fit([ids[ends[i] : ends[i + 1]] for i in order], got["grade"].to_numpy()[order].astype(np.int64), used)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability`` (P of the best grade), from whole texts.

    A null text counts as empty: it has no words, and how many words there are
    is a feature. Rows are scored one by one; a column of ``docs`` named as an
    added one is replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))  # a fixed number of weights
    docs = docs.drop("expected_grade", "tail_probability", "__t")

    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, m = Features(), Model(*shared.value)
        for batch in batches:
            scores = np.array([m.score(features(t)) for t in batch["__t"].to_pylist()], float)
            tail = m.tail(scores)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1])], [*names, "expected_grade", "tail_probability"])

    schema = T.StructType(docs.schema.fields).add("expected_grade", "double").add("tail_probability", "double")
    return docs.withColumn("__t", text_of(text)).mapInArrow(run, schema)


def quality_grades(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, expected_grade, tail_probability and ``kept`` of every document."""
    found = scored(docs.select("doc_id", "text"), trained(docs, labels, limit))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), (F.col("tail_probability") >= keep_from).alias("kept"))
