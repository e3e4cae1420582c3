"""URL filter: rules first, then words found in host names.

Host names often run words together. A unigram model, counted over the text of
all pages, splits each label of a host into its likeliest words (Viterbi). A
multinomial naive Bayes model scores these words and the words of the path. Its
labels come from what the pages say: a ``teacher``, the quality model of labelled
documents, grades each page's text, and the pages of which it is sure are
learned from. Without a teacher the rules' verdicts are the labels, and the
rules' own words, which decide them, are no features. Labels of hosts meet their
possible words in a join, so neither the vocabulary nor the hosts have to fit
anywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, spread_join, stored
from .ordinal import Features, Model


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
#: Letters, at most, of a word of the unigram model: no label of a valid host is longer, so no label has a longer word.
LONGEST_WORD = 63
#: Distinct words, at most, that naive Bayes knows: those that most labelled pages have.
VOCABULARY = 100_000
#: A teacher is sure of a page whose chance of the best grade is this or more, or as near to 0.
SURE = 0.8
#: Mark-up of a page, with what it does not show.
MARK_UP = r"(?si)<(script|style)\b.*?</\1\s*>|<[^>]*>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both are empty for a null url and one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return pages.withColumns({"host": F.translate(raw, _UPPER, _LOWER), "path": F.regexp_extract(tail, "^[^?#]*", 0)})


def ruled(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def letters_of(column: str) -> Column:
    """The runs of letters, of any script, in lower case."""
    return F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}]+"), lambda x: x != "")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: how often each word of 2 to LONGEST_WORD letters stands in the text of all pages, mark-up aside."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        mark_up = regex.compile(MARK_UP)
        word = regex.compile(rf"(?<!\p{{L}})\p{{L}}{{2,{LONGEST_WORD}}}(?!\p{{L}})")
        counts: Counter[str] = Counter()
        shown = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch["t"].to_pylist():
                counts.update(word.findall(mark_up.sub(" ", t).lower()))
                if len(counts) > 500_000:
                    yield shown()
                    counts.clear()
        yield shown()

    found = pages.filter(F.col(html).isNotNull()).select(F.col(html).alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def segmented(label: str, count_of: dict[str, int], total: int) -> list[str]:
    """The likeliest split of ``label``: known words by their frequency, unknown ones ever less likely with each letter.

    Of equally likely splits the one with the longer last words counts.
    """
    n = len(label)
    longest = max(map(len, count_of), default=1)
    unknown, letter = math.log(total + 1), math.log(10)
    best: list[tuple[float, int]] = [(0.0, 0)]
    # an unknown piece costs the same whatever its letters, so the best start of one is kept from step to step
    start_of_unknown = (math.inf, 0)
    for end in range(1, n + 1):
        begun = best[end - 1][0] - (end - 1) * letter, end - 1
        start_of_unknown = min(start_of_unknown, begun)
        options = [(start_of_unknown[0] + unknown + (end - 1) * letter, start_of_unknown[1])]
        for start in range(max(0, end - longest), end):
            if known := count_of.get(label[start:end]):
                options.append((best[start][0] - math.log(known / (total + 1)), start))
        best.append(min(options))
    words, end = [], n
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


class NaiveBayes(NamedTuple):
    """Multinomial, with one count added to every word; words that no labelled page has say nothing."""

    prior: float
    weight: dict[str, float]

    @classmethod
    def fitted(cls, counts: dict[str, tuple[int, int]], totals: tuple[int, int], pages: tuple[int, int]) -> NaiveBayes:
        """``counts``: of each word, how often blocked and allowed pages have it; ``totals``: of all words; one page is added to either side."""
        n = [t + len(counts) for t in totals]
        weight = {w: math.log((b + 1) / n[0]) - math.log((a + 1) / n[1]) for w, (b, a) in counts.items()}
        return cls(math.log((pages[0] + 1) / (pages[1] + 1)), weight)

    def score(self, words: list[str]) -> float:
        return math.fsum(self.weight.get(w, 0.0) for w in words)


def host_words(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """label, words: the split of every distinct label (run of letters) of the column ``host``."""
    small_batches(hosts.sparkSession)
    labels = hosts.select(F.explode(F.array_distinct(letters_of("host"))).alias("label")).distinct()
    pieces = (
        labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start"))
        .select("label", "start", F.explode(F.sequence(F.lit(2), F.lit(LONGEST_WORD))).alias("n"))
        .filter("start + n - 1 <= length(label)")
        .select("label", F.expr("substring(label, start, n)").alias("word"))
        .distinct()
    )
    # at most LONGEST_WORD pieces of a letter of a label meet here
    known = pieces.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            split = []
            for label, found in zip(batch["label"].to_pylist(), batch["known"].to_pylist()):
                split.append(segmented(label, {x["word"]: x["n"] for x in found or ()}, total))
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(split, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(run, "label string, words array<string>")


def words_of_rules(rules: tuple[Rule, ...]) -> list[str]:
    """The words that the rules themselves are made of, in their hosts and paths."""
    return sorted({w for r in rules for w in re.findall(r"[^\W\d_]+", r.name.lower())})


def trained(tokens: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: int = VOCABULARY, several_hosts: bool = False) -> NaiveBayes:
    """The model of all labelled pages: rows with ``given`` (block or allow) and ``words``.

    Words that the rules are made of are left out: they decide the labels, so
    what they seem to tell would not hold where no rule fits. With
    ``several_hosts`` so are words that pages of one ``host`` alone have, so that
    no verdict hangs on how the few pages of a single host were labelled.
    The ``vocabulary`` words that stand most often in them (ties: the smaller
    word) get a weight; their counts are all that the driver sees. Without
    labelled pages all weights and the prior are 0.
    """
    labelled = tokens.filter(F.col("given").isNotNull())
    blocked = F.col("given") == "block"
    both = lambda of: (F.count(F.when(blocked, of)), F.count(F.when(~blocked, of)))
    pages = labelled.agg(*both(F.lit(1))).first()
    host = F.col("host") if several_hosts else F.lit("")
    each = labelled.select("given", host.alias("host"), F.explode("words").alias("word")).filter(~F.col("word").isin(words_of_rules(rules)))
    totals = each.agg(*both(F.lit(1))).first()
    b, a = both(F.lit(1))
    counted = each.groupBy("word").agg(b.alias("b"), a.alias("a"), (F.min("host") < F.max("host")).alias("several"))
    if several_hosts:
        counted = counted.filter("several")
    found = counted.orderBy(F.desc(F.col("b") + F.col("a")), "word").limit(vocabulary).toArrow()
    counts = dict(zip(found["word"].to_pylist(), zip(found["b"].to_pylist(), found["a"].to_pylist())))
    return NaiveBayes.fitted(counts, tuple(totals), tuple(pages))


def taught(named: DataFrame, teacher: Model, sure: float = SURE) -> DataFrame:
    """row, page_id, url, label of ``named`` (these, and html): block or allow where the teacher is sure of the page's text, else null; null too without a text."""
    small_batches(named.sparkSession)
    shared = named.sparkSession.sparkContext.broadcast(tuple(teacher))  # a fixed number of weights

    def run(batches: Iterator) -> Iterator:
        import html

        import numpy as np
        import pyarrow as pa
        import regex

        mark_up, features, model = regex.compile(MARK_UP), Features(), Model(*shared.value)
        for batch in batches:
            texts = [html.unescape(mark_up.sub(" ", t)) if t else "" for t in batch["html"].to_pylist()]
            best = model.tail(np.array([model.score(features(t)) for t in texts], float))[:, -1]
            labels = [None if not t.strip() else "allow" if p >= sure else "block" if p <= 1 - sure else None for t, p in zip(texts, best.tolist())]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["page_id"], batch["url"], pa.array(labels, pa.string())], ["row", "page_id", "url", "label"])

    return named.select("row", "page_id", "url", "html").mapInArrow(run, "row long, page_id long, url string, label string")


def url_words(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", page_id: str = "page_id", teacher: Model | None = None) -> DataFrame:
    """row, page_id, host, path, rule, given (the rule's verdict), label (what is learned from, or null) and words of every page, written out."""
    spark = pages.sparkSession
    small_batches(spark)
    rule, verdict = ruled(rules)
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("row"))
    named = taught(named, teacher) if teacher else named.drop("html")
    label = F.col("label") if teacher else verdict
    parts = stored(parsed(named).select("row", "page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), label.alias("label")), "urls")
    hosts = stored(parts.groupBy("host").count(), "hosts")
    counts = stored(word_counts(pages, html), "unigrams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # labels come back to their hosts in the order in which they stand
    placed = hosts.select("host", F.posexplode(letters_of("host")).alias("place", "label"))
    of_host = (
        placed.join(host_words(hosts, counts, total), "label")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("host_words"))
    )
    none = F.array().cast("array<string>")
    split = hosts.select("host").join(of_host, "host", "left").select("host", F.coalesce("host_words", none).alias("host_words"))
    # a host may have a third of the pages: its rows are dealt to several tasks
    met = spread_join(parts, split, ["host"], hosts, "row")
    tokens = stored(met.select("row", "page_id", "host", "path", "rule", "given", "label", F.concat("host_words", letters_of("path")).alias("words")), "url-words")
    discard(parts)
    return tokens


_TOKENS = "row long, page_id long, host string, path string, rule string, given string, label string, words array<string>"


def scored_words(tokens: DataFrame, model: NaiveBayes) -> DataFrame:
    """``tokens`` with ``score``: how much likelier the words are on blocked pages (logarithm)."""
    shared = tokens.sparkSession.sparkContext.broadcast(tuple(model))  # VOCABULARY words at most

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bayes = NaiveBayes(*shared.value)
        for batch in batches:
            found = [round(bayes.prior + bayes.score(words), 6) for words in batch["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return tokens.mapInArrow(score, _TOKENS + ", score double")


def learned(tokens: DataFrame, rules: tuple[Rule, ...], teacher: Model | None) -> NaiveBayes:
    """The model of the labelled pages: without words of a single host if a teacher made the labels, without the rules' words if rules did."""
    return trained(tokens.select(F.col("label").alias("given"), "host", "words"), () if teacher else rules, several_hosts=teacher is not None)


def judged_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", page_id: str = "page_id", teacher: Model | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score of every page.

    The verdict is that of the longest rule that fits, else ``block`` where
    naive Bayes, learned from all pages of whose text the ``teacher`` is sure
    (without one: that a rule judges), finds the words of host and path likelier
    on blocked pages (``score`` above 0; a tie is allowed). A null url has an
    empty host and path, no words, and the prior alone decides; a null page text
    adds no words to the unigram model and teaches nothing. Repeated
    rows count and come out as often; an empty table gives none; other columns
    are ignored.
    """
    tokens = url_words(pages, rules, url, html, page_id, teacher)
    return scored_words(tokens, learned(tokens, rules, teacher)).select(
        "page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score",
    )


def held_out(pages: DataFrame, teacher: Model, fold: int = 5, rules: tuple[Rule, ...] = RULES) -> dict[str, int]:
    """How many pages of one of ``fold`` parts, by a hash of the row, a model of the other parts judges rightly and wrongly by their urls.

    Keys: block_block, block_allow, allow_block, allow_allow: the teacher's
    label, then the model's; pages without a label do not count. Rules only
    serve to be parsed; their verdicts are left aside.
    """
    tokens = url_words(pages, rules, teacher=teacher)
    tested = F.pmod(F.xxhash64("row"), F.lit(fold)) == 0
    model = learned(tokens.filter(~tested), rules, teacher)
    judged = scored_words(tokens.filter(tested & F.col("label").isNotNull()), model)
    found = judged.groupBy(F.concat_ws("_", "label", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("pair")).count()
    return {f"{a}_{b}": 0 for a in ("block", "allow") for b in ("block", "allow")} | {r["pair"]: r["count"] for r in found.collect()}
