"""The three analyses from tables of trips and stations to a report and rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..functions.names import shown, slug
from ..functions.routes import literal_set
from ..operators import boundary, pairs, regional, systemwide, walks
from ..sources import scenarios as files
from ..sources.settled import settled
from . import reports


@dataclass
class Analysis:
    """A report, and the rows behind it by the suffix of their file."""

    markdown: str
    rows: dict[str, DataFrame]
    summary: str = ""


class EmptyError(ValueError):
    """Nothing to classify."""


def day_label(day_type: str, days: tuple[str, ...] | None, explicit: bool) -> str:
    return "+".join(days or ()) if explicit else day_type


def regional_flow(trips: DataFrame, complexes: DataFrame, region: tuple[str, Column], days: tuple[str, ...] | None, label: str, command: str, top_n: int = 25) -> Analysis:
    name, inside = region
    regional.check_region(complexes, inside)
    cover = pairs.coverage(trips, days)
    found = pairs.pair_sums(trips, days).cache()
    pairs.check_ends(found, complexes)
    flows = regional.classified(found, complexes, inside)
    total = regional.quadrants(flows, cover.n_days).first()
    top = regional.top_pairs(flows, cover.n_days, top_n).collect()
    intro = f"Average {label} ridership ({cover.n_days} distinct days in the data, {cover.label()}): every station pair by whether its ends lie in {name}."
    rows = flows.select("origin_id", "origin_name", "dest_id", "dest_name", pairs.average(F.col("ridership"), cover.n_days).alias("riders"), "origin_in", "dest_in")
    return Analysis(reports.document(f"Regional Flow: {name}", intro, command, [reports.regional(total, top, label, top_n)]), {"": rows}, reports.regional_summary(total, label))


@dataclass(frozen=True)
class Junction:
    """What the boundary analysis is about."""

    boundary_id: int
    universe: frozenset[str]
    primary: frozenset[str]
    corridor_a: frozenset[str]
    corridor_b: frozenset[str]
    origin_side: str = "south"
    dest_side: str = "north"
    exclude_boundary: bool = False
    label_a: str = "corridor A"
    label_b: str = "corridor B"


def one_seat_rides(
    trips: DataFrame, complexes: DataFrame, platforms: DataFrame, junction: Junction, assignments: list[tuple[str, bool, list[str], list[str]]],
    days: tuple[str, ...] | None, label: str, command: str, close_m: float = systemwide.CLOSE_M, top_n: int = 25,
) -> Analysis:
    j = junction
    boundary.check_assignment(assignments, set(j.primary), set(j.universe))
    spot = complexes.filter(F.col("complex_id") == j.boundary_id).select("lat", "name").first()
    if spot is None:
        raise pairs.UnknownStationError(f"the boundary complex {j.boundary_id} is not in the station table")
    u, p = literal_set(j.universe), literal_set(j.primary)
    starts = boundary.origins(complexes, u, spot.lat, j.origin_side).cache()
    ids = sorted(r[0] for r in starts.select("complex_id").collect())  # stations
    cover = pairs.coverage(trips, days)
    found = pairs.pair_sums(trips, days, pairs.origin_in(ids)).cache()
    pairs.check_ends(found, complexes)
    crossing = boundary.scoped(found, starts, complexes, boundary.in_dest_scope(j.boundary_id, spot.lat, j.dest_side, j.exclude_boundary))
    spark = trips.sparkSession
    table = spark.createDataFrame(assignments, "scenario string, active boolean, to_a array<string>, to_b array<string>")
    effective = boundary.effective_routes(starts, table, p, literal_set(j.corridor_a), literal_set(j.corridor_b)).cache()
    rows = boundary.classified(crossing, effective, complexes, platforms, walks.walk_points(complexes, platforms), walks.line_partners(platforms, p), set(j.universe), set(j.primary), close_m).cache()
    swap = lambda a, b: f"{','.join(sorted(a))} on {j.label_a}, {','.join(sorted(b))} on {j.label_b}"
    labels = {n: swap(a, b) if active else swap(j.corridor_a & j.primary, j.corridor_b & j.primary) for n, active, a, b in assignments}
    totals = boundary.totals(rows, cover.n_days).collect()
    if not totals:
        raise EmptyError("no trip crosses the boundary")
    with_riders = rows.withColumn("riders", pairs.average(F.col("ridership"), cover.n_days))
    dests = boundary.dest_stats(rows, cover.n_days)
    totals.sort(key=lambda t: list(labels).index(t.scenario))
    alone = len(totals) == 1
    parts = [] if alone else [reports.corridor_comparison(totals, labels, label)]
    busiest = {}
    for t in totals:
        of = lambda df, t=t: df.filter(F.col("scenario") == t.scenario)
        top = reports.largest(of(with_riders), top_n, F.desc("riders"), "origin_id", "dest_id")
        best = reports.largest(of(dests), top_n, F.desc("one_seat"), "dest_id")
        busiest[t.scenario] = reports.largest(of(dests), top_n, F.desc("total"), "dest_id")
        parts.append(reports.corridor(t, top, best, labels[t.scenario], top_n, reports.corridor_headline(t, label, close_m) if alone else None))
    parts.append(reports.corridor_notes(close_m))
    assigned = any(active for _, active, _, _ in assignments)
    stray = boundary.off_corridors(starts, literal_set(j.corridor_a), literal_set(j.corridor_b)).orderBy("complex_id").collect() if assigned else []  # stations
    warnings = [f"warning: {r.name} ({','.join(r.routes)}) is on neither corridor and keeps its routes" for r in stray]
    fields = ["origin_id", "origin_name", "origin_routes", "dest_id", "dest_name", "dest_routes", "riders", "one_seat", "close", "dist_m", "near_station"]
    intro = f"Average {label} ridership ({cover.n_days} distinct days in the data, {cover.label()}) from stations on the {j.origin_side} side of {spot.name} to those on the {j.dest_side} side."
    csv = {("_" + n if len(assignments) > 1 else ""): with_riders.filter(F.col("scenario") == n).select(*fields) for n in labels}
    summary = "\n".join([*warnings, reports.corridor_summary(totals, busiest, labels, label)])
    return Analysis(reports.document(f"One Seat Rides at {spot.name} ({','.join(sorted(j.universe))})", intro, command, parts), csv, summary)


def nested_rows(rows: DataFrame) -> DataFrame:
    """What the analysis gives of each pair under each scenario: its ends and the walk as structs. ``rows`` has riders and the walk's station beside what :func:`systemwide.evaluated` gives."""
    end = lambda p: F.struct(F.col(f"{p}_id").alias("id"), F.col(f"{p}_station").alias("station"), F.col(f"{p}_routes").alias("routes"))
    walk = F.struct(F.col("close"), F.coalesce("walk.dist_m", F.lit(0.0)).alias("dist_m"), F.col("walk_station").alias("station"), F.coalesce("walk.at_origin", F.lit(False)).alias("at_origin"))
    return rows.select("scenario", end("origin").alias("origin"), end("dest").alias("destination"), "riders", "both_ends", "one_seat", walk.alias("walk"))


def deinterlining(
    trips: DataFrame, complexes: DataFrame, platforms: DataFrame, compared: list[files.Scenario],
    days: tuple[str, ...] | None, label: str, command: str, close_m: float = systemwide.CLOSE_M, top_n: int = 25,
) -> Analysis:
    spark, names = trips.sparkSession, [s.name for s in compared]
    if compared[0].moves:
        raise files.ScenarioError("the first scenario has to be today's routing")
    routes = literal_set(compared[0].routes)
    scenarios, overrides = files.frames(spark, compared)
    at = settled(walks.platform_routes(platforms, overrides, scenarios, routes), "platforms")
    stations = settled(walks.complex_routes(complexes, at, overrides, scenarios, routes).coalesce(1), "stations")
    near = settled(walks.nearest(walks.walk_points(complexes, platforms), at, stations), "near")
    ends = settled(walks.station_ends(stations, near, platforms).coalesce(1), "ends")
    scope = systemwide.scope(stations)
    cover = pairs.coverage(trips, days)
    n = cover.n_days
    found = pairs.pair_sums(trips, days, pairs.either_end_in([r[0] for r in scope.collect()])).cache()
    pairs.check_ends(found, complexes)
    known = bitmaps.dictionary(ends)
    table = settled(systemwide.station_table(ends, scope, known).coalesce(1), "table")
    base = settled(systemwide.evaluated(found, table.filter(F.col("scenario") == names[0]), known, close_m), "base")
    changed = settled(systemwide.touched(table, names[0], known).coalesce(1), "touched")
    rows = systemwide.with_differences(base, table, changed, names[0], known, close_m).cache()
    both, wider = systemwide.rider_stats(rows.filter("both_ends"), n).collect(), systemwide.rider_stats(rows, n).collect()
    if len(wider) < len(names) or not all(s.total for s in wider):
        raise EmptyError("no ridership among the station pairs in scope")
    if len(both) < len(names):
        raise EmptyError("no ridership between stations that are both in scope")
    listed = ",".join(sorted(compared[0].routes))
    by_name = lambda stats: {x.scenario: x for x in stats}
    titles = "Both Ends on the Comparison's Routes", "Either End on the Comparison's Routes"
    if len(names) > 1:
        parts = [[f"## {reports.COMPARISON}", f"### {titles[0]}", reports.levels(both, names), f"### {titles[1]}", reports.levels(wider, names)]]
    else:
        parts = [reports.levels_headline(both[0], wider[0], close_m)]
    moves = systemwide.compared(rows, names[0]).cache()
    changes = systemwide.changed_pairs(moves, n).cache()
    cells, gains = systemwide.transition_matrix(moves, n).collect(), {g.scenario: g for g in systemwide.gained_lost(moves, n).collect()}
    top_changes = systemwide.top_changes(changes, top_n).collect()
    by_station = systemwide.station_changes(changes, n).join(F.broadcast(systemwide.changed_stations(ends, names[0])), ["scenario", "complex_id"])
    full = systemwide.with_walk_station(rows, ends).withColumns({"riders": pairs.average(F.col("ridership"), n), "dist_m": F.col("walk.dist_m"), "at_origin": F.col("walk.at_origin"), "origin_name": shown(F.col("origin_station"), F.col("origin_routes")), "dest_name": shown(F.col("dest_station"), F.col("dest_routes"))})
    folded = systemwide.symmetric(full.filter("both_ends"), n, carried=("outcome", "dist_m", "at_origin", "walk_station", "origin_name", "dest_name"))
    origin, dest = (systemwide.station_stats(rows, side, n).join(F.broadcast(ends.select("scenario", "complex_id", shown(F.col("station"), F.col("routes")).alias("name"))), ["scenario", "complex_id"]) for side in ("origin", "dest"))
    for name in names:
        of = lambda df, name=name: df.filter(F.col("scenario") == name)
        total = next(s.total for s in both if s.scenario == name)
        part = [f"## {name}"]
        if name != names[0]:
            stations_moved = reports.largest(of(by_station), top_n, F.desc("magnitude"), F.desc("total"), "complex_id")
            part += reports.transitions([c for c in cells if c.scenario == name], gains.get(name), [c for c in top_changes if c.scenario == name], stations_moved, names[0], total)
        part += reports.scenario_tables(reports.largest(of(folded), top_n, F.desc("riders"), "origin_id", "dest_id"), *(reports.largest(of(s), top_n, F.desc("total"), "complex_id") for s in (origin, dest)), total)
        parts.append(part)
    flat = nested_rows(full)
    ordered = {title: [by_name(stats)[s] for s in names] for title, stats in zip(titles, (both, wider))}
    summary = reports.levels_summary(ordered, (gains[s] for s in names if s in gains), names[0])
    intro = f"Average {label} ridership ({n} distinct days in the data, {cover.label()}) over every station pair with an end served by {listed} under any scenario."
    part_of_name = {r.scenario: r.slug for r in scenarios.select("scenario", slug(F.col("scenario")).alias("slug")).collect()}  # a handful
    return Analysis(reports.document(f"Deinterlining Scenario Comparison: {listed}", intro, command, parts), {("_" + part_of_name[s] if len(names) > 1 else ""): flat.filter(F.col("scenario") == s).drop("scenario") for s in names}, summary)
