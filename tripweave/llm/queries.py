"""The subpackage's queries over the standard tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(spark, table(spark, folder, "documents"))


def op6_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    from .content_sort import content_groups

    return content_groups(table(spark, folder, "documents")).drop("row")


def op7_threshold_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .rules import judged

    return judged(table(spark, folder, "documents"))


def op2_url_words(spark: SparkSession, folder: str) -> DataFrame:
    from .ordinal import trained
    from .url_filter import judged_urls

    return judged_urls(table(spark, folder, "pages"), teacher=trained(table(spark, folder, "documents"), table(spark, folder, "labels")))


def op3_rlz_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from .rlz import digests

    return digests(table(spark, folder, "documents"))


def op4_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mixture_rates

    return mixture_rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    from .ordinal import quality_grades

    return quality_grades(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    from .sparse_suffix import listed_passages

    return listed_passages(table(spark, folder, "documents"))


def op9_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    from .chosen_path import similarity_classes

    return similarity_classes(table(spark, folder, "documents")).drop("row")


def op10_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from .bpe import encoded_digests

    return encoded_digests(table(spark, folder, "documents"))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, folder, "documents"))


def op13_annulus_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from .centroids import clustered

    return clustered(table(spark, folder, "embeddings"))


def op12_fast_sketch(spark: SparkSession, folder: str) -> DataFrame:
    from .fast_sketch import near_components

    return near_components(table(spark, folder, "documents")).drop("row")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, p, array_to_string(words[p:p+19], ' ') AS window_text FROM s),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, p) AS place FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM f WHERE place > 1),
g AS (SELECT doc_id, list(q) AS removed FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.q) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id LEFT JOIN y ON w.doc_id = y.doc_id
"""


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS p, words FROM w WHERE len(words) >= 50),
k AS (SELECT doc_id, p, array_to_string(words[p:p+49], ' ') AS window_text FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY window_text) AS n FROM k) WHERE n > 1),
m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS starts FROM r),
g AS (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM m),
x AS (SELECT doc_id, min(p) - 1 AS a, max(p) + 49 AS z FROM g GROUP BY doc_id, span)
SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_repeated_words, string_agg(a || '-' || z, ' ' ORDER BY a) AS spans FROM x GROUP BY doc_id
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p+4], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS p FROM w WHERE len(words) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 9 * both_have >= 4 * (x.n + y.n)
      UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.doc_id <> y.doc_id AND len(x.words) = 0 AND len(y.words) = 0),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT l.a AS doc_id, class_id, coalesce(n_links, 0) AS n_links, l.a = class_id AS kept FROM l LEFT JOIN n ON n.a = l.a
"""


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
x AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
g AS (SELECT lang, words[i] AS phrase, 1 AS size FROM x
      UNION ALL SELECT lang, array_to_string(words[i:i+1], ' '), 2 FROM x WHERE i + 1 <= len(words)
      UNION ALL SELECT lang, array_to_string(words[i:i+2], ' '), 3 FROM x WHERE i + 2 <= len(words)),
f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT lang, size, phrase, lang || chr(10) || phrase AS key, f FROM f WHERE f >= 10),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM h WHERE size > 1),
k AS MATERIALIZED (SELECT lang, size, phrase, a, k, lang || chr(10) || array_to_string(words[1:k], ' ') AS k1, lang || chr(10) || array_to_string(words[k+1:], ' ') AS k2
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.lang, k.size, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000 * k.a * k.a) // (x.f * y.f) AS score FROM k JOIN h x ON x.key = k.k1 JOIN h y ON y.key = k.k2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS MATERIALIZED (SELECT key, max(a) AS longer FROM (
      SELECT lang || chr(10) || array_to_string(words[1:size-1], ' ') AS key, a FROM c UNION ALL SELECT lang || chr(10) || array_to_string(words[2:], ' '), a FROM c) GROUP BY key),
d AS (SELECT b.*, lang || chr(10) || phrase AS key FROM b),
o AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM d LEFT JOIN e ON e.key = d.key WHERE 100 * coalesce(longer, 0) < 50 * a)
SELECT o.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[p:p+4], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS p FROM w WHERE len(words) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT l.a AS doc_id, coalesce(c.n, 0) AS n_shingles, component_id, l.a = component_id AS kept FROM l LEFT JOIN c ON c.doc_id = l.a
"""


def sql_of_rules() -> str:
    """The measures and the table of thresholds, once more, as SQL."""
    from .rules import STOP_WORDS, SYMBOLS, THRESHOLDS

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join(
        "(" + (" AND ".join(
            ([f"{t.measure.split(' / ')[0]} >= {t.low} * {(t.measure.split(' / ') + ['1'])[1]}"] if t.low is not None else [])
            + ([f"{t.measure.split(' / ')[0]} <= {t.high} * {(t.measure.split(' / ') + ['1'])[1]}"] if t.high is not None else [])
        ) or "TRUE") + f" OR n_words < {t.from_words})"
        for t in THRESHOLDS
    )
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, p, array_to_string(words[p:p+4], ' ') AS gram FROM g),
r AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt
      FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM k) WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(least(5, coalesce(nxt - p, 5))) AS BIGINT) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b
"""


def sql_of_clusters(rounds: int = 3) -> str:
    """Every vector compared with every centroid, round after round."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (SELECT vec_id, q, c, d FROM (
  SELECT v.vec_id, v.q, c, list_sum(list_transform(list_zip(v.q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{turn})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if turn < rounds:
            steps.append(f"""
u{turn} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{turn}) GROUP BY c, i) GROUP BY c),
c{turn + 1} AS MATERIALIZED (SELECT o.c, coalesce(u.m, o.m) AS m FROM c{turn} o LEFT JOIN u{turn} u ON u.c = o.c)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q AS m FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 16)),{",".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_rlz_substrings": OP3_SQL, "op8_sparse_suffixes": OP8_SQL, "op9_chosen_path": OP9_SQL, "op6_content_sort": OP6_SQL, "op7_threshold_rules": sql_of_rules(), "op11_phrase_collocations": OP11_SQL, "op12_fast_sketch": OP12_SQL, "op13_annulus_clusters": sql_of_clusters()}
