"""Queries of the subpackage against their SQL, over the whole small tables."""

import os

import duckdb
import pytest

from tripweave.llm import queries

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for name_of_table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {name_of_table} AS SELECT * FROM '{FOLDER}/{name_of_table}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    rows = lambda df: df[columns].astype(str).sort_values(columns).values.tolist()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in queries.queries()[name](spark, FOLDER).select(key).collect()]
    assert set(got) == ids if not name.startswith("op8_") else set(got) < ids
    assert len(got) == len(set(got))


URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(rh, rp, verdict))
SELECT p.page_id, p.host, p.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
"""


def test_rules_of_urls_equal_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = {r[0]: r[1:] for r in duck.sql(URL_SQL).fetchall()}
    got = queries.queries()["op2_url_words"](spark, FOLDER).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {i: r[:3] for i, r in want.items()}
    assert all(r.verdict == want[r.page_id][3] for r in got if r.rule)
