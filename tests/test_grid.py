"""The nearest goals by cells against all distances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.operators.grid import nearest_goals

ASKED, GOALS = "g string, id int, lat double, lon double", "g string, to_lat double, to_lon double, goal int"


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def place(rng, kind):
    if kind == "town":
        return 40.5 + rng.random() * 0.4, -74.2 + rng.random() * 0.5
    if kind == "globe":
        return rng.uniform(-90, 90), rng.uniform(-180, 180)
    if kind == "dateline":
        return rng.uniform(-17, -16), rng.choice((-1, 1)) * rng.uniform(179, 180)
    return rng.choice((-1, 1)) * rng.uniform(89, 90), rng.uniform(-180, 180)


@pytest.mark.parametrize("kind", ["town", "globe", "dateline", "poles"])
def test_nearest_equals_all_distances(spark, kind):
    rng = random.Random(kind)
    goals = [(rng.choice("AB"), *place(rng, kind), i) for i in range(60)] + [("C", *place(rng, kind), 99)]
    goals += [(g, a, b, i + 100) for g, a, b, i in goals[:5]]  # ties go by the goal
    asked = [(g, i, *place(rng, kind)) for i in range(60) for g in "ABCD"] + [("A", 999, goals[0][1], goals[0][2])]
    got = {(r.g, r.id): r for r in nearest_goals(spark.createDataFrame(asked, ASKED), spark.createDataFrame(goals, GOALS), ["g"], ["goal"]).collect()}
    assert set(got) == {(g, i) for g, i, *_ in asked if g != "D"}  # D has no goals
    for g, i, a, b in asked:
        if g != "D":
            want = min((metres(a, b, c, d), n) for h, c, d, n in goals if h == g)
            assert got[g, i].best.dist_m == pytest.approx(want[0], rel=1e-9, abs=1e-3)
            near = {n for h, c, d, n in goals if h == g and metres(a, b, c, d) <= want[0] + 1e-6}
            assert got[g, i].best.goal == min(near)


def test_no_goals_and_nothing_asked(spark):
    some, none = spark.createDataFrame([("A", 1, 40.0, -74.0)], ASKED), spark.createDataFrame([], GOALS)
    assert nearest_goals(some, none, ["g"], ["goal"]).count() == 0
    assert nearest_goals(some.limit(0), spark.createDataFrame([("A", 40.0, -74.0, 1)], GOALS), ["g"], ["goal"]).count() == 0


def test_compared_pairs_grow_with_the_places(spark):
    def compared(n):
        spot = lambda salt, kind: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_003)) / 1_000_003).alias(kind)
        group = F.substring(F.concat(F.lit("A"), "id"), 1, 1).alias("g")  # not a constant to the optimizer
        asked = spark.range(n).select(group, "id", (40 + spot(1, "x")).alias("lat"), (-74 + spot(2, "y")).alias("lon"))
        goals = spark.range(n).select(group, (40 + spot(3, "x")).alias("to_lat"), (-74 + spot(4, "y")).alias("to_lon"), F.col("id").alias("goal"))
        found = nearest_goals(asked, goals, ["g"], ["goal"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        return found.agg(F.sum("compared"), F.count(F.lit(1))).first()

    few, many = compared(200), compared(20_000)
    assert (few[1], many[1]) == (200, 20_000)
    assert many[0] < 100 * 20_000 and many[0] / few[0] < 300  # of 400,000,000 pairs; a hundred times the places


