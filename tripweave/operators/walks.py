"""Stations under scenarios: who serves what, where riders stand, and the nearest platform of every route.

All of this is about a few hundred stations, so it is worked out once per
scenario and station and joined to pairs afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routes import any_of, common, with_delta
from .grid import if_small, nearest_goals

NEAR = "array<struct<route:string,dist_m:double,point:int,platform:int,to_complex:int>>"


def walk_points(complexes: DataFrame, platforms: DataFrame) -> DataFrame:
    """complex_id, point, platform_id, lat, lon: the platforms of a complex, or its centre if it has none.

    Points are numbered within the whole table: platforms by their number, centres after them.
    """
    own = platforms.select("complex_id", "platform_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    joined = complexes.select("complex_id", "lat", "lon").join(F.broadcast(own), "complex_id", "left")
    return joined.select(
        "complex_id", F.coalesce("platform_id", F.lit(1_000_000) + F.col("complex_id")).cast("int").alias("point"), "platform_id",
        F.coalesce("p_lat", "lat").alias("lat"), F.coalesce("p_lon", "lon").alias("lon"),
    )


def platform_routes(platforms: DataFrame, overrides: DataFrame, scenarios: DataFrame, universe: Column) -> DataFrame:
    """Every platform under every scenario: its routes in the universe after the scenario's changes to its line.

    ``overrides``: scenario, complex_id, line, add, remove, one row a key.
    """
    each = platforms.crossJoin(F.broadcast(scenarios.select("scenario")))  # a handful of scenarios
    joined = each.join(F.broadcast(overrides), ["scenario", "complex_id", "line"], "left")
    changed = F.when(F.col("add").isNotNull(), with_delta(F.col("routes"), F.col("add"), F.col("remove"))).otherwise(F.col("routes"))
    return joined.select("scenario", "platform_id", "complex_id", "line", "name", "lat", "lon", F.col("routes").alias("real_routes"), common(changed, universe).alias("routes"))


def complex_routes(complexes: DataFrame, at_platforms: DataFrame, overrides: DataFrame, scenarios: DataFrame, universe: Column) -> DataFrame:
    """Every complex under every scenario: the union over its platforms where the scenario changes it, else its own routes."""
    touched = overrides.select("scenario", "complex_id").distinct()
    unions = at_platforms.groupBy("scenario", "complex_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("moved"))
    moved = touched.join(unions, ["scenario", "complex_id"], "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<string>")))
    each = complexes.crossJoin(F.broadcast(scenarios.select("scenario")))
    return each.join(F.broadcast(moved), ["scenario", "complex_id"], "left").select(
        "scenario", "complex_id", "name", "lat", "lon", "borough", F.coalesce("moved", common(F.col("routes"), universe)).alias("routes")
    )


def narrowed_names(stations: DataFrame, platforms: DataFrame) -> DataFrame:
    """``stations`` (complex_id, name, routes) with ``station``: the one name of the platforms whose real routes meet the station's, else its own."""
    real = platforms.groupBy("complex_id").agg(F.collect_list(F.struct("name", "routes")).alias("__own"))
    with_own = stations.join(F.broadcast(real), "complex_id", "left")
    names = F.array_distinct(F.transform(F.filter("__own", lambda p: any_of(p["routes"], F.col("routes"))), lambda p: p["name"]))
    return with_own.withColumn("station", F.when(F.size(names) == 1, names[0]).otherwise(F.col("name"))).drop("__own")


def nearest(points: DataFrame, at_platforms: DataFrame, stations: DataFrame) -> DataFrame:
    """scenario, complex_id, route, best: the nearest platform of each route from where riders of a complex stand.

    They stand at its platforms that serve a route of the universe, or at all
    its points if none does. Equal distances go by point and platform.
    """
    served = at_platforms.filter(F.size("routes") > 0)
    standing = stations.select("scenario", "complex_id").join(points, "complex_id")
    marked = standing.join(served.select("scenario", "platform_id", F.lit(True).alias("serves")), ["scenario", "platform_id"], "left")
    # Of points at one place the first counts, so what is compared grows with the places, not with the platforms.
    spots = marked.groupBy("scenario", "complex_id", "lat", "lon").agg(F.min("point").alias("any"), F.min(F.when(F.col("serves"), F.col("point"))).alias("serving"))
    some = spots.groupBy("scenario", "complex_id").agg(F.count("serving").alias("n"))
    stand = spots.join(some, ["scenario", "complex_id"]).filter("serving IS NOT NULL OR n = 0").select("scenario", "complex_id", "lat", "lon", F.coalesce("serving", "any").alias("point"))
    goal = (
        served.select("scenario", "platform_id", F.col("complex_id").alias("to_complex"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.explode("routes").alias("route"))
        .groupBy("scenario", "route", "to_lat", "to_lon")
        .agg(F.min(F.struct(F.col("platform_id").alias("platform"), "to_complex")).alias("to"))
    )
    goals = goal.select("scenario", "route", "to_lat", "to_lon", "to.platform", "to.to_complex")
    found = nearest_goals(stand, goals, ["scenario", "route"], ["point", "platform", "to_complex"])
    return found.groupBy("scenario", "complex_id", "route").agg(F.min("best").alias("best"))


def station_ends(stations: DataFrame, near: DataFrame, platforms: DataFrame) -> DataFrame:
    """One row per scenario and complex: station name, routes, and the nearest platforms of all routes."""
    listed = near.groupBy("scenario", "complex_id").agg(F.collect_list(F.struct("route", "best.dist_m", "best.point", "best.platform", "best.to_complex")).alias("near"))
    named = narrowed_names(stations, platforms)
    return named.join(F.broadcast(listed), ["scenario", "complex_id"], "left").withColumn("near", F.coalesce("near", F.array().cast(NEAR)))


def line_partners(platforms: DataFrame, primary: Column) -> DataFrame:
    """complex_id, partners: the primary routes on the lines, within the borough, that a complex's platforms are on."""
    on_line = platforms.groupBy("line", "borough").agg(F.array_distinct(F.flatten(F.collect_list("routes"))).alias("on_line"))
    joined = platforms.select("complex_id", "line", "borough").join(F.broadcast(on_line), ["line", "borough"])
    return joined.groupBy("complex_id").agg(F.flatten(F.collect_list("on_line")).alias("r")).select("complex_id", common(F.array_distinct("r"), primary).alias("partners"))


def nearest_to_sets(points: DataFrame, platforms: DataFrame, sets: DataFrame, served: DataFrame) -> DataFrame:
    """scenario, routes_key, complex_id, best: from all points of a complex the nearest platform whose complex serves the set.

    ``sets``: scenario, routes_key, wanted. ``served``: scenario, complex_id, serves.
    """
    goal = served.join(F.broadcast(platforms.select("complex_id", "platform_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))), "complex_id")
    wanted = goal.join(F.broadcast(sets), "scenario").filter(any_of(F.col("serves"), F.col("wanted")))
    target = wanted.select("scenario", "routes_key", "platform_id", F.col("complex_id").alias("to_complex"), "to_lat", "to_lon")
    # of platforms and of points at one place the first counts
    goals = target.groupBy("scenario", "routes_key", "to_lat", "to_lon").agg(F.min(F.struct(F.col("platform_id").alias("platform"), "to_complex")).alias("to"))
    spots = points.groupBy("complex_id", "lat", "lon").agg(F.min("point").alias("point"))
    found = nearest_goals(spots, goals.select("scenario", "routes_key", "to_lat", "to_lon", "to.platform", "to.to_complex"), ["scenario", "routes_key"], ["point", "platform", "to_complex"])
    return found.groupBy("scenario", "routes_key", "complex_id").agg(F.min("best").alias("best"))
