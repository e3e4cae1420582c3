"""The boundary analysis: one junction, two corridors, trips that cross it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import shown
from ..functions.routes import any_of, assigned_routes, common, literal_set, prefer
from .pairs import average
from .walks import nearest_to_sets


def on_side(lat: Column, boundary_lat: Column, side: str) -> Column:
    """Strictly south or north of the boundary; ``either`` takes all."""
    return {"either": F.lit(True), "south": lat < boundary_lat, "north": lat > boundary_lat}[side]


def origins(complexes: DataFrame, universe: Column, boundary_lat: float, side: str) -> DataFrame:
    """The complexes on the origins' side that serve a route of the universe."""
    return complexes.filter(any_of(F.col("routes"), universe) & on_side(F.col("lat"), F.lit(boundary_lat), side))


def in_dest_scope(boundary_id: int, boundary_lat: float, side: str, exclude_boundary: bool = False) -> Column:
    """Of columns dest_id and dest_lat: on the destinations' side, or the boundary itself unless excluded."""
    at_boundary = F.lit(False) if exclude_boundary else F.col("dest_id") == boundary_id
    return at_boundary | on_side(F.col("dest_lat"), F.lit(boundary_lat), side)


def scoped(pairs: DataFrame, starts: DataFrame, complexes: DataFrame, rule: Column) -> DataFrame:
    """Pairs from the origins to destinations in scope, with the destination's latitude."""
    o = F.broadcast(starts.select(F.col("complex_id").alias("origin_id")))
    d = F.broadcast(complexes.select(F.col("complex_id").alias("dest_id"), F.col("lat").alias("dest_lat")))
    return pairs.join(o, "origin_id", "left_semi").join(d, "dest_id").filter(rule)


def effective_routes(starts: DataFrame, scenarios: DataFrame, primary: Column, corridor_a: Column, corridor_b: Column) -> DataFrame:
    """scenario, complex_id, effective: the origins' routes under each assignment of corridors.

    ``scenarios``: scenario, active, to_a, to_b.
    """
    each = starts.crossJoin(F.broadcast(scenarios))  # at most three scenarios
    given = assigned_routes(F.col("routes"), primary, corridor_a, corridor_b, F.col("to_a"), F.col("to_b"))
    return each.select("scenario", "complex_id", "name", "routes", F.when(F.col("active"), given).otherwise(F.col("routes")).alias("effective"))


def off_corridors(starts: DataFrame, corridor_a: Column, corridor_b: Column) -> DataFrame:
    """The origins on neither corridor, which keep their routes whatever is assigned."""
    return starts.filter(~any_of(F.col("routes"), corridor_a) & ~any_of(F.col("routes"), corridor_b)).select("complex_id", "name", "routes")


def swap_scenarios(trunk_a: set[str], trunk_b: set[str], primary: set[str]) -> list[tuple[str, bool, list[str], list[str]]]:
    """Rows (scenario, active, to_a, to_b): actual routing, and the two ways to give a trunk to a corridor."""
    a, b = sorted(trunk_a & primary), sorted(trunk_b & primary)
    return [("actual", False, [], []), ("a", True, a, b), ("b", True, b, a)]


def check_assignment(scenarios: list[tuple[str, bool, list[str], list[str]]], primary: set[str], universe: set[str]) -> None:
    """Every corridor needs a primary route of the universe."""
    for name, active, to_a, to_b in scenarios:
        for corridor, given in (("A", to_a), ("B", to_b)):
            if active and not set(given) & primary & universe:
                raise ValueError(f"scenario {name!r} assigns corridor {corridor} no primary route in scope")


def one_seat(effective: Column, dest_routes: Column, universe: Column, primary: Column, partners: Column) -> tuple[Column, Column]:
    """Whether a trip needs no transfer, and the routes that both ends share.

    A shared route counts if it is primary, or if no primary route of the
    origin's own line serves the destination.
    """
    shared = common(F.array_intersect(effective, dest_routes), universe)
    return (F.size(shared) > 0) & (any_of(shared, primary) | ~any_of(dest_routes, partners)), shared


def classified(
    trips: DataFrame, effective: DataFrame, complexes: DataFrame, platforms: DataFrame, points: DataFrame, partners: DataFrame,
    universe: set[str], primary: set[str], close_m: float,
) -> DataFrame:
    """One row per scenario and pair: one_seat, close, dist_m, near_station, and the labels of both ends.

    The walk of a trip with a transfer leads from the destination, anywhere in
    its complex, to a platform whose complex serves the origin's corridor.
    """
    u, p = literal_set(universe), literal_set(primary)
    own = effective.join(F.broadcast(partners), "complex_id", "left").select(
        "scenario", F.col("complex_id").alias("origin_id"), F.col("name").alias("origin_name"), "effective",
        F.coalesce("partners", F.array().cast("array<string>")).alias("partners"), common(F.col("effective"), u).alias("wanted"),
        F.array_join(common(F.col("effective"), u), ",").alias("routes_key"),
    )
    to = complexes.select(F.col("complex_id").alias("dest_id"), F.col("name").alias("dest_name"), F.col("routes").alias("dest_routes"))
    # under a scenario an origin serves its assigned routes, every other complex its own
    served = complexes.crossJoin(F.broadcast(effective.select("scenario").distinct())).join(F.broadcast(effective.select("scenario", "complex_id", "effective")), ["scenario", "complex_id"], "left")
    serves = served.select("scenario", "complex_id", F.coalesce("effective", "routes").alias("serves"))
    near = nearest_to_sets(points, platforms, own.select("scenario", "routes_key", "wanted").distinct(), serves)
    near = near.join(F.broadcast(complexes.select(F.col("complex_id").alias("__c"), F.col("name").alias("__name"), F.col("routes").alias("__routes"))), F.col("best.to_complex") == F.col("__c"))
    near = near.select("scenario", "routes_key", F.col("complex_id").alias("dest_id"), F.col("best.dist_m").alias("walk_m"), shown(F.col("__name"), common(F.col("__routes"), u)).alias("walk_to"))
    rows = trips.join(F.broadcast(own), "origin_id").join(F.broadcast(to), "dest_id").join(F.broadcast(near), ["scenario", "routes_key", "dest_id"], "left")
    direct, shared = one_seat(F.col("effective"), F.col("dest_routes"), u, p, F.col("partners"))
    rows = rows.withColumns({"one_seat": direct, "shared": shared})
    exit_routes = F.when(~F.col("one_seat") & (F.col("walk_m") == 0.0), common(F.col("partners"), F.col("dest_routes"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"ridden": prefer(F.col("shared"), p), "exit_routes": exit_routes})
    dest_label = F.when(F.col("one_seat"), F.col("ridden")).when(F.size("exit_routes") > 0, F.col("exit_routes")).otherwise(prefer(common(F.col("dest_routes"), u), p))
    origin_label = F.when(F.col("one_seat"), F.col("ridden")).otherwise(F.col("wanted"))
    return rows.select(
        "scenario", "origin_id", shown(F.col("origin_name"), origin_label).alias("origin_name"), F.array_join("effective", ",").alias("origin_routes"), "dest_id",
        F.col("dest_name").alias("dest_plain"), shown(F.col("dest_name"), dest_label).alias("dest_name"), F.array_join("dest_routes", ",").alias("dest_routes"), "ridership", "one_seat",
        (F.col("one_seat") | F.coalesce(F.col("walk_m") <= close_m, F.lit(False))).alias("close"), F.when(F.col("one_seat"), 0.0).otherwise(F.col("walk_m")).alias("dist_m"),
        F.when(~F.col("one_seat"), F.col("walk_to")).alias("near_station"),
        F.when(F.col("one_seat"), F.col("ridden")).otherwise(F.col("exit_routes")).alias("arrival_routes"),
    )


def totals(rows: DataFrame, n_days: int) -> DataFrame:
    """total, one_seat, xfer, close and effective (one-seat or close) riders of each scenario."""
    r = F.col("ridership")
    part = lambda c: average(F.coalesce(F.sum(F.when(c, r)), F.lit(0)), n_days)
    return rows.groupBy("scenario").agg(
        average(F.sum(r), n_days).alias("total"), part(F.col("one_seat")).alias("one_seat"), part(~F.col("one_seat")).alias("xfer"),
        part(~F.col("one_seat") & F.col("close")).alias("close"), part(F.col("close")).alias("effective"),
    )


def origin_totals(rows: DataFrame, effective: DataFrame, n_days: int) -> DataFrame:
    """total and one_seat of every origin, those without trips included."""
    r = F.col("ridership")
    found = rows.groupBy("scenario", F.col("origin_id").alias("complex_id")).agg(F.sum(r).alias("t"), F.sum(F.when(F.col("one_seat"), r)).alias("s"))
    zero = F.lit(0).cast("decimal(38,4)")
    return effective.select("scenario", "complex_id").join(found, ["scenario", "complex_id"], "left").select("scenario", "complex_id", average(F.coalesce("t", zero), n_days).alias("total"), average(F.coalesce("s", zero), n_days).alias("one_seat"))


def dest_stats(rows: DataFrame, n_days: int) -> DataFrame:
    """Riders of every destination, with the share and the mean distance, weighted by riders, of trips with a transfer."""
    r, x = F.col("ridership"), ~F.col("one_seat")
    zero = F.lit(0).cast("decimal(38,4)")
    got = rows.groupBy("scenario", "dest_id").agg(
        F.sum(r).alias("t"), F.coalesce(F.sum(F.when(~x, r)), zero).alias("s"), F.coalesce(F.sum(F.when(x, r)), zero).alias("m"), F.coalesce(F.sum(F.when(x & F.col("close"), r)), zero).alias("c"),
        F.sum(F.when(x, r.cast("double") * F.col("dist_m"))).alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("arrival_routes")))).alias("arrival"),
        F.min("dest_plain").alias("plain"), F.min("dest_name").alias("label"),
    )
    some = F.col("m") > 0
    return got.select(
        "scenario", "dest_id", F.when(F.size("arrival") > 0, shown(F.col("plain"), F.col("arrival"))).otherwise(F.col("label")).alias("name"),
        average(F.col("t"), n_days).alias("total"), average(F.col("s"), n_days).alias("one_seat"), average(F.col("m"), n_days).alias("xfer"), average(F.col("c"), n_days).alias("xfer_close"),
        F.round(100 * F.col("s").cast("double") / F.col("t").cast("double"), 6).alias("one_seat_pct"),
        F.when(some, F.round(100 * F.col("c").cast("double") / F.nullif(F.col("m"), F.lit(0)).cast("double"), 6)).alias("xfer_close_pct"),
        F.when(some, F.round(F.col("w") / F.nullif(F.col("m"), F.lit(0)).cast("double"), 4)).alias("xfer_dist_m"),
    )


