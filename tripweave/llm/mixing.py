"""Mixing to target weights with soft membership.

A classifier, trained on a labelled table, gives every document posterior
probabilities of the domains. Projected gradient descent then finds one rate
for every document, none negative, such that the expected tokens of the domains
meet their targets in the least-squares sense. A document's rate is 1, moved
along its posteriors and projected back between its bounds, so it is an
expression of as many multipliers as there are domains, and rates are never
stored between steps. A step of the multipliers, scaled by the curvature, needs
one aggregate, and steps go on until the first-order condition holds.

Everything runs as built-in functions; the driver handles the domains' numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .rules import SPACES

#: Hashed words that the classifier tells apart, and labelled ids, at most, that it learns from.
BUCKETS, SAMPLE_IDS = 4096, 20_000
#: How far the mean evidence of a word counts: as much for a long text as for a short one, so that mixed texts stay mixed.
SHARPNESS = 6.0
#: Weight of changes of rates beside the distance to the targets; part of all tokens by which the first-order condition may be off.
RIDGE, EXACT = 1e-7, 1e-6
#: That weight where rows are drawn: rates then follow the posteriors smoothly, at the price of a thousandth of all tokens.
SMOOTH = 1e-3
#: Domains and weights of the query.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


_ADDED = ("tokens", "posteriors", "__ids", "__e", "__x", "__row")


def word_ids(text: str = "text") -> Column:
    words = F.filter(F.split(text_of(text), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.hash(F.lower(w)), F.lit(BUCKETS)))


def log_weights(labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the hashed words in each domain, and of the domains, from labelled rows (text, domain).

    Words are counted on the executors; the driver sees BUCKETS numbers a domain at most.
    """
    words = labelled.filter(F.col("domain").isin(domains)).select("domain", F.explode(word_ids()).alias("id"))
    n = np.ones((len(domains), BUCKETS))
    for r in words.groupBy("domain", "id").count().collect():
        n[domains.index(r["domain"]), r["id"]] += r["count"]
    total = n.sum(axis=1)
    return np.log(n / total[:, None]), np.log(total / total.sum())


def _numbers(values: np.ndarray) -> str:
    """A constant array, as one literal: the optimizer folds it, and no tree of thousands of nodes is built."""
    return "cast(split('" + ",".join(f"{v:.6f}" for v in values) + "', ',') AS array<double>)"


def with_posteriors(docs: DataFrame, weights: np.ndarray, prior: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and ``posteriors`` (an array in the order of the domains); without words the prior holds."""
    centred = weights - weights.mean(axis=0)  # the same for all domains, so it cancels
    df = docs.withColumn("__ids", word_ids(text))
    evidence = [F.expr(f"aggregate(__ids, 0D, (a, i) -> a + element_at({_numbers(w)}, i + 1)) / greatest(size(__ids), 1) * {SHARPNESS}D + {p:.6f}D") for w, p in zip(centred, prior)]
    df = df.withColumns({"tokens": F.size("__ids").cast("long"), "__e": F.array(*evidence)}).drop("__ids")
    df = df.withColumn("__x", F.transform("__e", lambda e: F.exp(e - F.array_max("__e")))).drop("__e")
    return df.withColumn("posteriors", F.transform("__x", lambda x: x / F.aggregate("__x", F.lit(0.0), lambda a, b: a + b))).drop("__x")


def _wanted(multipliers: np.ndarray) -> Column:
    """What a document's rate would be if it had no bounds: 1, moved along its posteriors."""
    return F.lit(1.0) - reduce(Column.__add__, [F.col("posteriors")[k] * F.lit(float(v)) for k, v in enumerate(multipliers)])


def rate(multipliers: np.ndarray, most: float | None = None) -> Column:
    """A document's rate: from 1 along its posteriors, and back to 0 if that is below, or to ``most`` if above."""
    moved = F.greatest(F.lit(0.0), _wanted(multipliers))
    return moved if most is None else F.least(F.lit(float(most)), moved)


Point = tuple[float, np.ndarray, np.ndarray]


def solved(at: Callable[[np.ndarray], Point], targets: np.ndarray, total: float, weight: float = RIDGE) -> np.ndarray:
    """The multipliers whose projected rates meet the first-order condition of the least squares.

    ``at`` gives, for multipliers, half the sum of the squared rates in tokens
    (linear beyond a bound), the domains' tokens, and the Gram matrix of the
    rows whose rate is at no bound. With a small ``weight`` on changes of the
    rates, which makes them unique, the multipliers are the residuals divided by
    it, and are the minimum of a convex function whose gradient and curvature
    these are. Each step is the gradient, scaled by the curvature, and halved
    until the function falls as it should; steps go on until the condition holds.
    """
    k, x = len(targets), np.zeros(len(targets))
    unit = max(1.0, total)
    for ridge in (*(r for r in (1e-2, 1e-3, 1e-4, 1e-5, 1e-6) if r > weight), weight):  # each starts where the one before ended
        keep = ridge * unit

        def value(x: np.ndarray, point: Point, keep: float = keep) -> float:
            return 0.5 * keep * float(x @ x) + point[0] + float(x @ targets)

        here = at(x)
        while True:
            slope = keep * x - (here[1] - targets)
            if np.abs(slope).max() <= EXACT * unit:
                break
            step = -np.linalg.solve(here[2] + keep * np.eye(k), slope)
            part, now = 1.0, value(x, here)
            while True:
                there = at(x + part * step)
                if value(x + part * step, there) <= now + 1e-4 * part * float(slope @ step):
                    break
                part /= 2
                if part < 1e-12:  # as near as numbers of 64 bits can tell
                    return x
            x, here = x + part * step, there
    return x


def fitted(members: DataFrame, targets: np.ndarray, most: float | None = None, weight: float = RIDGE) -> np.ndarray:
    """Multipliers for :func:`rate` with which the domains' expected tokens come as near to ``targets`` as rates from 0 to ``most`` allow.

    Each step is one aggregate over ``members`` (tokens, posteriors), of a few numbers a pair of domains.
    """
    k = len(targets)
    p, t = [F.col("posteriors")[i] for i in range(k)], F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = lambda c: F.coalesce(F.sum(t * c), F.lit(0.0))

    def at(x: np.ndarray) -> Point:
        free, bound = _wanted(x), rate(x, most)
        inside = F.when((free > 0) & (F.lit(True) if most is None else free < most), 1.0).otherwise(0.0)
        first, *rest = members.agg(total(bound * (free - bound / 2)), *[total(bound * q) for q in p], *[total(inside * p[i] * p[j]) for i, j in pairs]).first()
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, rest[k:]):
            gram[i, j] = gram[j, i] = v
        return float(first), np.array(rest[:k]), gram

    return solved(at, targets, float(targets.sum()), weight)


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], text: str = "text") -> DataFrame:
    """``docs`` without their texts, with tokens and posteriors, written out."""
    weights, prior = log_weights(labelled, domains)
    docs = docs.drop(*[c for c in _ADDED if c != text])
    return stored(with_posteriors(docs, weights, prior, text).drop(text), "memberships")


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], text: str = "text", budget: int | None = None) -> DataFrame:
    """The rows of ``docs`` without text, with tokens, posteriors and ``rate``.

    ``labelled`` has columns text and domain. Rates make the expected tokens of
    each domain its weight's share of ``budget`` (all tokens of ``docs`` if
    none is given); a target out of reach is met as nearly as rates that are
    not negative allow. Null and empty texts have no tokens and the prior as
    posteriors. Every row has its own rate, repeated rows the same. Columns
    named as an added one are replaced; an empty table gives no rows, and a
    labelled table without rows posteriors that are all alike.
    """
    domains = list(weights)
    members = memberships(docs, labelled, domains, text)
    total = budget if budget is not None else members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = np.array([weights[d] for d in domains], float)
    return members.withColumn("rate", rate(fitted(members, share / share.sum() * total)))


def labelled_languages(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_IDS) -> DataFrame:
    """text and domain (the language) of the documents of at most ``limit`` ids of the labelled table, chosen by a hash.

    Null ids are left out; all rows of a chosen id count.
    """
    ids = labels.select("doc_id").dropna().distinct()
    share = min(1.0, 0.97 * limit / max(1, ids.count()))  # so that the limit hardly ever cuts
    few = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(limit)
    # ``limit`` numbers at most
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(F.broadcast(few), "doc_id").select("text", "domain")


def mixture_rates(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, the posterior of each domain, and rate of every document."""
    found = mixed(docs.select("doc_id", "text"), labelled_languages(docs, labels), weights)
    return found.select("doc_id", "tokens", *[F.round(F.col("posteriors")[i], 6).alias(f"p_{d}") for i, d in enumerate(weights)], F.round("rate", 6).alias("rate"))


def thinned(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """The rows of ``docs`` that stay if each does with its rate as the chance.

    No row comes twice, so rates are fitted between 0 and 1: the domains' kept
    tokens meet their ``weights``' shares of all tokens, or, where a domain has
    fewer, all that it has, and no other domain loses rows for it. Targets are
    thus within reach: the least squares of one out of reach would choose
    among rows of the other domains by traces of it in their posteriors.
    Rows are numbered in the table that their posteriors are written to, and a
    hash of the number decides, so null and repeated ids and equal texts are
    drawn row by row. Null and empty texts have the prior as posteriors. All
    columns stay, whatever their names; an empty table gives no rows.
    """
    domains = list(weights)
    own = {c: f"__own_{c}" for c in docs.columns if c in _ADDED}
    w, prior = log_weights(labelled, domains)
    judged = with_posteriors(docs.withColumnsRenamed(own), w, prior).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(judged, "memberships")
    members = rows.select("tokens", "posteriors")
    total = members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = np.array([weights[d] for d in domains], float)
    present = members.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("posteriors")[i]), F.lit(0.0)) for i in range(len(domains))]).first()
    multipliers = fitted(members, np.minimum(share / share.sum() * total, present), 1.0, SMOOTH)
    chance = F.pmod(F.xxhash64("__row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(chance < rate(multipliers, 1.0)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
