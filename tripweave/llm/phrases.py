"""Phrases whose words stand together more often than chance: collocation mining.

Every n-gram of up to ``max_n`` words becomes a row, and a hash aggregate
counts rows by language and phrase. Frequent phrases are joined to the counts
of what they fall into when cut in two, scored in decimals, which are exact,
and dropped where a frequent phrase of one word more takes their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored, text_of

#: Longest phrases in words; occurrences that make a candidate; part (in 100) of a phrase that an extension takes to replace it; phrases of a language.
MAX_N, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: What ends a piece; phrases never go across it.
BREAKS = r"[.,;:!?\x0A-\x0D]"
#: Parts of a language whose best phrases are found apart before the best of all.
PARTS = 64
#: Frequent phrases of a word less, at most, that are broadcast as 64-bit hashes to rule longer ones out.
KNOWN = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNT = "decimal(16,0)"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, times: the words of the distinct pieces of all texts, A-Z in lower case, and how often a piece stands there.

    Lines and passages that many texts share are taken apart once.
    """
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text_of(text), BREAKS)).alias("piece"))
    trimmed = named.select("lang", F.expr("trim(BOTH ' \\t' FROM piece)").alias("piece")).filter("piece <> ''")
    known = trimmed.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))
    piece = F.col("piece")
    lower = F.when(F.octet_length(piece) == F.length(piece), F.lower(piece)).otherwise(F.translate(piece, _UPPER, _UPPER.lower()))
    single = F.when(piece.contains("\t") | piece.contains("  "), F.regexp_replace(lower, "[ \t]+", " ")).otherwise(lower)
    return known.select("lang", F.split(single, " ").alias("words"), "times")


def _gram(n: int, after: int = 0) -> Column:
    """The ``n`` words from ``after`` words past a position on; null where the piece ends before."""
    words = [F.get("words", F.col("at") + (after + i)) for i in range(n)]
    return F.concat(*[x for w in words for x in (F.lit(" "), w)][1:])


def _summed(rows: DataFrame, least: int) -> DataFrame:
    # Most phrases are rare. Keys of bytes keep the aggregate from trying its small first-level table in vain.
    named = rows.filter("phrase IS NOT NULL").select("lang", F.col("phrase").cast("binary").alias("phrase"), "times")
    counts = named.groupBy("lang", "phrase").agg(F.sum("times").alias("f")).filter((F.col("f") >= least) | (F.octet_length("phrase") == 0))
    phrase = F.col("phrase").cast("string")
    size = F.when(phrase == "", 0).otherwise(1 + F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))))
    return counts.select("lang", phrase.alias("phrase"), size.alias("size"), "f")


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, text: str = "text", lang: str = "lang", known: int = KNOWN) -> DataFrame:
    """lang, phrase, size, f of the phrases of 1 to ``max_n`` words that occur ``least`` times or more; all words of a language count as size 0, phrase ''.

    Rows are made one position at a time, so a long piece without a break is
    never held as a list of its phrases, and summed in each task before the
    shuffle, so a frequent phrase is one row of each task. From three words on
    a phrase can only be frequent if the phrases of a word less in it are; as
    long as these are few enough to broadcast (``known``, checked each time),
    rows that this rules out are left out before they are summed. Beyond that
    all are summed. The result is the same.
    """
    apart = stored(pieces(docs, text, lang), "pieces")
    placed = apart.select("lang", "words", "times", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    # the first word of a piece also tells how many words the piece has
    total = F.struct(F.when(F.col("at") == 0, "").alias("phrase"), (F.size("words") * F.col("times")).alias("times"))
    short = [F.struct(_gram(n).alias("phrase"), F.col("times").alias("times")) for n in range(1, min(max_n, 2) + 1)]
    rows = placed.select("lang", F.explode(F.array(total, *short)).alias("g")).select("lang", "g.phrase", "g.times")
    found = [stored(_summed(rows, least), "phrases")]
    for n in range(3, max_n + 1):
        shorter = found[-1].filter(F.col("size") == n - 1).select(F.xxhash64("lang", "phrase").alias("key")).distinct()
        here = placed.filter(F.size("words") - F.col("at") >= n)
        if shorter.count() <= known:
            for side in (0, 1):
                here = here.withColumn("key", F.xxhash64("lang", _gram(n - 1, side))).join(F.broadcast(shorter), "key", "left_semi").drop("key")
        found.append(stored(_summed(here.select("lang", _gram(n).alias("phrase"), "times"), least), "phrases"))
    discard(apart)
    return reduce(DataFrame.unionAll, found)


def best_of_each(rows: DataFrame, top: int) -> DataFrame:
    """``rank`` and the columns of the first ``top`` rows of each language by score, frequency and phrase: first of PARTS parts, then of their best."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = dealt.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= top)
    return best.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, covered: int = COVERED, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``max_n`` words of each language.

    a, l and r count the phrase and the two parts of the cut with the lowest
    score, n all words of the language; the score is floor(10**6 a a / (l r)).
    A phrase is dropped if one of a word more, which holds it, has ``covered``
    in 100 of its occurrences or more. Longer ones need no look: what they
    cover, the extension between covers too.

    A null language is ``und``; null, empty and blank texts have no words;
    repeated rows count each time; ties go by frequency, then by the phrase's
    bytes. An empty table gives no rows; further columns are ignored. Counts
    are exact up to 5 * 10**15.
    """
    if least < 1 or covered < 0:
        raise ValueError("phrases need one occurrence at least, and a share")
    counts = phrase_counts(docs, max_n, least, text, lang)
    candidates = counts.filter((F.col("size") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda p, f: counts.filter("size > 0").select("lang", F.col("phrase").alias(p), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = both.withColumns({f"__{c}": F.col(c).cast(_COUNT) for c in "alr"})
    # div gives the whole part of the quotient of two decimals: nothing is rounded
    scored = wide.withColumn("score", F.expr("(1000000 * __a * __a) div (__l * __r)")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.array(F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"), F.expr("substring_index(phrase, ' ', size - 1)"))
    extensions = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    taken = (scored["lang"] == extensions["lang"]) & (scored["phrase"] == extensions["phrase"]) & (100 * extensions["longer"].cast(_COUNT) >= covered * scored["a"].cast(_COUNT))
    kept = scored.join(extensions, taken, "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))  # one row a language
    return best_of_each(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
