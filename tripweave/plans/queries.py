"""One query for each operator of the ridership analyses, over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.names import abbreviated, month_label, outcome, slug
from ..functions.routes import literal_set
from ..operators import boundary, pairs, regional, systemwide
from ..sources import changes, ridership
from .analyses import nested_rows
from .model import TRUNK_A, UNIVERSE, Model, model
from .reports import flattened

Query = Callable[[SparkSession, str], DataFrame]
BOROUGHS = ["ASIA", "EUROPE"]
BOX = (40.55, -74.1, 40.75, -73.85)


def _joined(column: str):
    return F.array_join(F.col(column), ",")


def ingest_normalize(m: Model) -> DataFrame:
    value = ridership.ridership_value(F.col("ridership").cast("decimal(12,6)") / 3, 2)
    return m.trips.select("year", "month", "day_of_week", "hour", "origin_id", "dest_id", value.cast("double").alias("ridership"))


def day_coverage(m: Model) -> DataFrame:
    return pairs.coverage_table(m.trips, pairs.WEEKDAYS)


def _pairs(m: Model, found: DataFrame) -> DataFrame:
    return found.select("origin_id", "dest_id", pairs.average(F.col("ridership"), m.n_days).alias("riders"))


def od_pairs(m: Model) -> DataFrame:
    return _pairs(m, m.pairs)


def od_pairs_scoped(m: Model) -> DataFrame:
    ids = [r[0] for r in m.in_scope.collect()]
    return _pairs(m, pairs.pair_sums(m.trips, pairs.WEEKDAYS, pairs.either_end_in(ids)))


def od_pairs_origin_semi(m: Model) -> DataFrame:
    ids = [r[0] for r in m.origins.select("complex_id").collect()]
    return _pairs(m, pairs.pair_sums(m.trips, pairs.WEEKDAYS, pairs.origin_in(ids)))


def _quadrants(m: Model, region) -> DataFrame:
    return regional.quadrants(regional.classified(m.pairs, m.complexes, region), m.n_days)


def region_cbd_quadrants(m: Model) -> DataFrame:
    return _quadrants(m, geo.in_cbd())


def region_borough_quadrants(m: Model) -> DataFrame:
    return _quadrants(m, geo.in_boroughs(BOROUGHS))


def region_bbox_quadrants(m: Model) -> DataFrame:
    return _quadrants(m, geo.in_box(*BOX))


def regional_top_pairs(m: Model) -> DataFrame:
    return regional.top_pairs(regional.classified(m.pairs, m.complexes, geo.in_cbd()), m.n_days, 25)


def route_sets(m: Model) -> DataFrame:
    return m.complexes.select("complex_id", _joined("routes").alias("routes"), F.size("routes").alias("n_routes"))


def platform_narrowed_name(m: Model) -> DataFrame:
    return m.ends.select("scenario", "complex_id", "station", _joined("routes").alias("routes"))


def walk_points(m: Model) -> DataFrame:
    return m.points.select("complex_id", "point", F.coalesce("platform_id", F.lit(-1)).alias("platform_id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def scenario_routes(m: Model) -> DataFrame:
    return m.at_platforms.select("scenario", "platform_id", "complex_id", "line", _joined("real_routes").alias("real_routes"), _joined("routes").alias("routes"))


def scenario_product(m: Model) -> DataFrame:
    """Every choice of a route to take off each of two lines, or none."""
    served = m.platforms.filter(F.col("line").isin("L1", "L2")).select("line", F.explode("routes").alias("route")).distinct()
    options = served.select(F.col("line").alias("category"), F.concat("route", F.lit(" off "), "line").alias("scenario"), F.concat("line", F.lit(" without "), "route").alias("description"))
    return changes.combinations(options).drop("parts")


def station_lookup(m: Model) -> DataFrame:
    """What scenarios may call stations: name and line of every platform, and the complexes that they mean."""
    return changes.station_names(m.platforms).withColumnRenamed("station", "name")


def _wanted(m: Model) -> DataFrame:
    """C takes the place of A, and D of B, on two lines wherever these run."""
    return changes.union(changes.exchanged(m.platforms, "One", "C for A", "L1", "A", "C"), changes.exchanged(m.platforms, "Two", "D for B", "L2", "B", "D"))


def scenario_moves(m: Model) -> DataFrame:
    """Wanted changes placed, and all combinations of their scenarios."""
    wanted = _wanted(m)
    combined = changes.combinations(wanted.select("category", "scenario", F.col("scenario").alias("description")).distinct())
    moves = changes.combined_moves(changes.placed_changes(wanted, m.platforms), combined)
    return moves.select("scenario", "complex_id", "line", _joined("add").alias("add"), _joined("remove").alias("remove"))


def scenario_faults(m: Model) -> DataFrame:
    """What is wrong with taking A away, and adding it where the platform's number is odd, at every platform of line L1 and the next line."""
    at = m.platforms.filter(F.col("line") == "L1").withColumn("line", F.explode(F.array(F.lit("L1"), F.lit("L2"))))
    both = F.explode(F.when(F.col("platform_id") % 2 == 1, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(-1)))).alias("sign")
    wanted = at.select(F.lit("One").alias("category"), F.lit("No A").alias("scenario"), "line", F.col("name").alias("station"), F.lit("A").alias("route"), both)
    return changes.faults(wanted, m.platforms)


def abbreviated_names(m: Model) -> DataFrame:
    """Long forms in names of stations, and the names as part of a file name."""
    long = F.concat(F.lit("Park Place "), "name", F.lit(" Atlantic Av-Barclays Ctr, Port Authority Bus Terminal"))
    return m.complexes.select("complex_id", abbreviated(long).alias("name"), slug(F.col("name")).alias("slug"))


def month_labels(m: Model) -> DataFrame:
    return m.trips.groupBy((F.col("year") * 100 + F.col("month")).alias("m")).agg(F.count(F.lit(1)).alias("trips")).select(month_label(F.col("m")).alias("month"), "trips")


def changed_stations(m: Model) -> DataFrame:
    """What each scenario calls a station, beside the baseline's name."""
    return systemwide.changed_stations(m.ends, "Current")


def off_corridors(m: Model) -> DataFrame:
    return boundary.off_corridors(m.origins, literal_set(TRUNK_A), literal_set({"D"})).select("complex_id", "name", _joined("routes").alias("routes"))


def one_seat_systemwide(m: Model) -> DataFrame:
    return m.rows.select("scenario", "origin_id", "dest_id", "both_ends", "one_seat")


def nearest_platform(m: Model) -> DataFrame:
    return m.near.select("scenario", "complex_id", "route", F.round("best.dist_m", 3).alias("dist_m"), F.col("best.platform").alias("platform_id"), F.col("best.to_complex").alias("to_complex"))


def shortest_walk(m: Model) -> DataFrame:
    """Where no walk can be measured, the distance is -1."""
    rows = systemwide.with_walk_station(m.rows.filter(~F.col("one_seat")), m.ends)
    return rows.select("scenario", "origin_id", "dest_id", F.coalesce(F.round("walk.dist_m", 3), F.lit(-1.0)).alias("dist_m"), F.coalesce("walk.at_origin", F.lit(False)).alias("at_origin"), "close", "walk_station")


def report_rows(m: Model) -> DataFrame:
    """The rows that the systemwide analysis writes as CSV, structs flattened."""
    full = systemwide.with_walk_station(m.rows, m.ends).withColumn("riders", pairs.average(F.col("ridership"), m.n_days))
    return flattened(nested_rows(full)).withColumn("walk_dist_m", F.round("walk_dist_m", 3))


def outcomes(m: Model) -> DataFrame:
    return m.rows.groupBy("scenario", "both_ends", outcome(F.col("one_seat"), F.col("close")).alias("outcome")).agg(F.count(F.lit(1)).alias("pairs"), pairs.average(F.sum("ridership"), m.n_days).alias("riders"))


def evaluated_pairs(m: Model) -> DataFrame:
    """How many pairs a scenario had to be worked out for; the others take today's outcome."""
    return m.rows.groupBy("scenario", "evaluated").agg(F.count(F.lit(1)).alias("pairs"))


def rider_stats_both_ends(m: Model) -> DataFrame:
    return systemwide.rider_stats(m.rows.filter("both_ends"), m.n_days)


def rider_stats_either_end(m: Model) -> DataFrame:
    return systemwide.rider_stats(m.rows, m.n_days)


def symmetric_pairs(m: Model) -> DataFrame:
    return systemwide.symmetric(m.rows.filter("both_ends"), m.n_days).drop("ridership")


def origin_stats(m: Model) -> DataFrame:
    return systemwide.station_stats(m.rows, "origin", m.n_days)


def destination_stats(m: Model) -> DataFrame:
    return systemwide.station_stats(m.rows, "dest", m.n_days)


def transition_matrix(m: Model) -> DataFrame:
    return systemwide.transition_matrix(m.moves, m.n_days)


def gained_lost_net(m: Model) -> DataFrame:
    return systemwide.gained_lost(m.moves, m.n_days)


def changed_pairs_topk(m: Model) -> DataFrame:
    return systemwide.top_changes(m.changes, 25)


def station_changes(m: Model) -> DataFrame:
    return systemwide.station_changes(m.changes, m.n_days)


def boundary_scope(m: Model) -> DataFrame:
    return _pairs(m, m.scoped)


def express_partners(m: Model) -> DataFrame:
    return m.partners.select("complex_id", _joined("partners").alias("partners"))


def effective_origin_routes(m: Model) -> DataFrame:
    return m.effective.select("scenario", "complex_id", _joined("routes").alias("routes"), _joined("effective").alias("effective"))


def one_seat_boundary(m: Model) -> DataFrame:
    return m.crossings.select("scenario", "origin_id", "dest_id", "origin_routes", "dest_routes", "one_seat", "origin_name", "dest_name")


def walk_boundary(m: Model) -> DataFrame:
    return m.crossings.select("scenario", "origin_id", "dest_id", F.round("dist_m", 3).alias("dist_m"), "close", "near_station")


def boundary_dest_stats(m: Model) -> DataFrame:
    return boundary.dest_stats(m.crossings, m.n_days)


def boundary_origin_stats(m: Model) -> DataFrame:
    return boundary.origin_totals(m.crossings, m.effective, m.n_days)


def corridor_swap_comparison(m: Model) -> DataFrame:
    return boundary.totals(m.crossings, m.n_days)


QUERIES: tuple[Callable[[Model], DataFrame], ...] = (
    ingest_normalize, day_coverage, od_pairs, od_pairs_scoped, od_pairs_origin_semi, region_cbd_quadrants, region_borough_quadrants, region_bbox_quadrants,
    regional_top_pairs, route_sets, platform_narrowed_name, walk_points, scenario_routes, scenario_product, one_seat_systemwide, nearest_platform, shortest_walk,
    report_rows, outcomes, evaluated_pairs, rider_stats_both_ends, rider_stats_either_end, symmetric_pairs, origin_stats, destination_stats, transition_matrix, gained_lost_net,
    changed_pairs_topk, station_changes, boundary_scope, express_partners, effective_origin_routes, one_seat_boundary, walk_boundary, boundary_dest_stats,
    boundary_origin_stats, corridor_swap_comparison, station_lookup, scenario_moves, scenario_faults, abbreviated_names, month_labels, changed_stations, off_corridors,
)


def queries() -> dict[str, Query]:
    return {f.__name__: (lambda spark, folder, f=f: f(model(spark, folder))) for f in QUERIES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of routes does to riders, from trips to the matrix of outcomes before and after."""
    return transition_matrix(model(spark, folder))


