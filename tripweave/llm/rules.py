"""Quality rules: a table of thresholds compiled into one projection.

Every measure is an expression of built-in functions over one row, so a scan
with a projection judges the whole corpus: no shuffle and no user functions.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_of

SPACES = r"[\x20\x09-\x0D]+"
#: Symbols that prose seldom has.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "be", "this", "are", "from", "or", "an",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "pour", "par", "sur", "est", "pas", "au", "aux", "dans",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "auf", "ein", "eine", "ist", "dem", "nicht", "sich", "im", "für",
    "el", "los", "las", "del", "que", "y", "por", "con", "no", "una", "se", "su", "para", "al",
)
WINDOW = 5


class Threshold(NamedTuple):
    """``measure`` must lie between ``low`` and ``high``; None leaves a side open. Shorter texts than ``from_words`` pass."""

    name: str
    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


#: The table that is compiled.
THRESHOLDS = (
    Threshold("length", "n_words", 10, 1_000_000),
    Threshold("word_length", "word_chars / n_words", 2, 20),
    Threshold("symbols", "n_symbols / n_words", None, 0.25),
    Threshold("stop_words", "n_stop_words / n_words", 0.02, None, 50),
    Threshold("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    Threshold("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.5),
    Threshold("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def repeated_words(words: Column | str = "words") -> list[tuple[str, Column]]:
    """Steps (name, expression) to ``n_repeat_words``: words in windows of five that the text holds at least twice.

    Windows are hashed; a text without an equal pair, which most are, is done
    after a distinct count. In others the windows are sorted by hash and equal
    neighbours keep their positions, n log n steps for any text.
    """
    return [
        ("word_hashes", F.transform(words, lambda w: F.xxhash64(w))),
        ("grams", F.expr(f"CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({', '.join(f'get(word_hashes, i + {k})' for k in range(WINDOW))})) ELSE array() END")),
        ("sorted_grams", F.expr("CASE WHEN size(array_distinct(grams)) < size(grams) THEN array_sort(transform(grams, (h, i) -> struct(h AS h, i AS i))) END")),
        ("places", F.expr("array_sort(filter(transform(sorted_grams, (x, j) -> CASE WHEN get(sorted_grams, j - 1).h = x.h OR get(sorted_grams, j + 1).h = x.h THEN x.i END), p -> p IS NOT NULL))")),
        ("n_repeat_words", F.expr(f"coalesce(aggregate(transform(places, (p, j) -> least({WINDOW}, coalesce(get(places, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)")),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and every measure of each document, from its whole text."""
    listed = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    df = docs.select("doc_id", text_of(text).alias("t"))
    df = df.withColumns({"words": F.filter(F.split("t", SPACES), lambda w: w != ""), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.translate("t", WHITE, "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_bullet_lines": F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
        "n_stop_words": F.expr(f"cast(size(filter(words, w -> lower(w) IN ({listed}))) AS long)"),
    })
    for name, expression in repeated_words():
        df = df.withColumn(name, expression)
    return df.drop("t", "words", "lines", "word_hashes", "grams", "sorted_grams", "places")


def compiled(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """One boolean expression: true where every threshold of the table holds. A ratio over nothing passes."""

    def holds(t: Threshold) -> Column:
        over, _, under = t.measure.partition(" / ")
        # compared as products: whole numbers on the left, so no division decides
        value, unit = F.col(over), F.col(under) if under else F.lit(1)
        sides = [F.lit(True)] + ([value >= unit * F.lit(t.low)] if t.low is not None else []) + ([value <= unit * F.lit(t.high)] if t.high is not None else [])
        return reduce(Column.__and__, sides) | (F.col("n_words") < t.from_words)

    return reduce(Column.__and__, map(holds, thresholds))


def judged(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Every row is
    judged alone, so ties, repeated rows and the other columns do not matter;
    an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(docs, text).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & compiled(thresholds)).alias("kept"),
    )
