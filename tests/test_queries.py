"""Every query against its SQL in DuckDB, and identities that hold whatever the data."""

import os

import duckdb
import pytest

from tripweave.plans import oracles, queries
from tripweave.plans.model import model

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.sql(oracles.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    for frame in (got, want):
        frame[columns] = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist()


def test_identities(spark):
    q = {name: lambda f=f: f(spark, FOLDER) for name, f in queries.queries().items()}
    both = {r.scenario: r for r in q["rider_stats_both_ends"]().collect()}
    wide = {r.scenario: r for r in q["rider_stats_either_end"]().collect()}
    matrix = q["transition_matrix"]().collect()
    for outcome, level in (("direct", both["Current"].one_seat), ("close", both["Current"].close)):
        assert sum(m.riders for m in matrix if m.before == outcome) == pytest.approx(level, abs=1e-4)
    g = q["gained_lost_net"]().first()
    assert g.net == pytest.approx(both["Swap"].effective - both["Current"].effective, abs=1e-4)
    assert both["Current"].one_seat == wide["Current"].one_seat and both["Current"].total == both["Swap"].total
    r = q["region_cbd_quadrants"]().first()
    assert r.inter + r.intra == pytest.approx(r.total, abs=1e-4) == pytest.approx(r.in_in + r.in_out + r.out_in + r.out_out, abs=1e-4)


def test_walks_are_symmetric(spark):
    rows = {(r.scenario, r.origin_id, r.dest_id): r for r in model(spark, FOLDER).rows.collect()}
    for (s, o, d), r in rows.items():
        if (back := rows.get((s, d, o))) is not None:
            assert r.outcome == back.outcome and (r.walk and r.walk.dist_m) == (back.walk and back.walk.dist_m)


def test_no_station_is_compared_with_all_others_and_pairs_meet_as_masks(spark):
    m = model(spark, FOLDER)
    assert m.rows.filter("NOT evaluated").count() > 0  # some pairs take today's outcome
    from tripweave.operators import systemwide, walks

    near = walks.nearest(m.points, m.at_platforms, m.stations)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in near and "Cartesian" not in near
    fresh = systemwide.evaluated(m.pairs, m.table, m.known)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in fresh for f in ("array_intersect", "array_contains", "transform(", "filter(", "lambda"))


def test_pairs_are_aggregated_under_a_pushed_filter(spark, tmp_path):
    from tripweave.operators import pairs

    trips = spark.range(0).selectExpr("2024 AS year", "1 AS month", "'Monday' AS day_of_week", "1 AS hour", "1 AS origin_id", "2 AS dest_id", "cast(1 AS decimal(9,4)) AS ridership")
    path = str(tmp_path / "trips")
    trips.write.mode("overwrite").parquet(path)
    plan = pairs.pair_sums(spark.read.parquet(path), pairs.WEEKDAYS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(day_of_week" in plan and "ReadSchema: struct<day_of_week:string,origin_id:int,dest_id:int,ridership:decimal(9,4)>" in plan
