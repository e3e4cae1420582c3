"""Command line: prepare, regional-flow, one-seat-rides, deinterlining, scenario-schema."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import SparkSession

from .operators import pairs, regional
from .operators.boundary import swap_scenarios
from .plans import analyses
from .plans.reports import csv_of
from .sources import ridership, scenarios
from .sources.fetch import CSV_PATTERN, STATIONS_INDIVIDUAL_URL, STATIONS_URL, fetch_csv


def routes(text: str) -> frozenset[str]:
    return frozenset(r.strip() for r in text.split(",") if r.strip())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tripweave")
    commands = top.add_subparsers(dest="command", required=True)
    prepare = commands.add_parser("prepare", help="CSV extracts to one clustered Parquet table")
    prepare.add_argument("csv", nargs="*", default=[], help="files, folders or patterns")
    prepare.add_argument("--csv", dest="more_csv", action="append", default=[])
    prepare.add_argument("--out", default="data/ridership.parquet")
    prepare.add_argument("--force", action="store_true")
    prepare.add_argument("--ridership-decimals", type=int)
    prepare.add_argument("--stations-out", default="data/stations.csv")
    prepare.add_argument("--stations-individual-out", default="data/stations_individual.csv")
    prepare.add_argument("--stations-url", default=STATIONS_URL)
    prepare.add_argument("--stations-individual-url", default=STATIONS_INDIVIDUAL_URL)
    prepare.add_argument("--force-stations", action="store_true")
    prepare.add_argument("--stations-only", action="store_true", help="only fetch the station tables, anew")

    def common(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--parquet", default="data/ridership.parquet")
        p.add_argument("--stations", default="data/stations.csv")
        p.add_argument("--day-type", choices=list(pairs.DAY_TYPES), default="weekday")
        p.add_argument("--days")
        p.add_argument("--csv-out")
        p.add_argument("--markdown-out")
        p.add_argument("--top-n", type=int, default=25)
        return p

    flow = common("regional-flow", "riders between a region and the rest")
    flow.add_argument("--region", choices=regional.PRESETS, default="cbd")
    for option in ("borough", "bbox", "label"):
        flow.add_argument(f"--region-{option}")
    seat = common("one-seat-rides", "trips across a junction")
    deinter = common("deinterlining", "routing scenarios compared")
    for p in (seat, deinter):
        p.add_argument("--stations-individual", default="data/stations_individual.csv")
        p.add_argument("--close-threshold-m", type=float, default=300.0)
    seat.add_argument("--boundary-complex-id", type=int, default=617)
    for side, default in (("origin", "south"), ("dest", "north")):
        seat.add_argument(f"--{side}-side", choices=("south", "north", "either"), default=default)
    seat.add_argument("--exclude-boundary-dest", action="store_true")
    seat.add_argument("--routes", type=routes, default=routes("B,D,N,Q"))
    seat.add_argument("--primary-routes", type=routes)
    for letter, trunk, corridor, label in (("a", "B,D", "D,N", "4 Av express"), ("b", "N,Q", "B,Q", "Brighton")):
        seat.add_argument(f"--trunk-{letter}", type=routes, default=routes(trunk))
        seat.add_argument(f"--origin-corridor-{letter}-routes", type=routes, default=routes(corridor))
        seat.add_argument(f"--origin-corridor-{letter}-label", default=label)
        seat.add_argument(f"--corridor-{letter}-assigned", type=routes)
    seat.add_argument("--all-corridor-scenarios", action="store_true")
    deinter.add_argument("--category", action="append", default=[])
    schema = commands.add_parser("scenario-schema", help="JSON Schema of scenario files")
    for p in (deinter, schema):
        p.add_argument("--scenario-file" if p is deinter else "--out", required=True)
    schema.add_argument("--stations", default="data/stations.csv")
    schema.add_argument("--stations-individual", default="data/stations_individual.csv")
    return top


class Said(NamedTuple):
    """What a command prints, and its report if it writes one."""

    summary: str
    report: str = ""


def prepared(spark: SparkSession, args: argparse.Namespace) -> Said:
    """Fetches the station tables that are not there yet, then writes the ridership table."""
    said = []
    for url, out in ((args.stations_url, args.stations_out), (args.stations_individual_url, args.stations_individual_out)):
        rows = fetch_csv(url, out, args.force_stations or args.stations_only)
        said.append(f"{out} is there already; use --force-stations to fetch it anew" if rows is None else f"wrote {out} ({rows} rows)")
    if not args.stations_only:
        if not args.force and ridership.is_there(spark, args.out):
            said.append(f"{args.out} is there already; use --force to write it anew")
        else:
            raw = ridership.read_csv_files(spark, args.csv + args.more_csv or [CSV_PATTERN])
            found = ridership.write_ridership(ridership.normalised(raw, args.ridership_decimals), args.out, True)
            said.append(f"wrote {args.out}: {found.rows:,} rows, {found.first_month} to {found.last_month}")
    return Said("\n".join(said))


def run(spark: SparkSession, argv: list[str]) -> Said:
    """Carries a command out."""
    args = parser().parse_args(argv)
    command = "tripweave " + " ".join(argv)
    if args.command == "prepare":
        return prepared(spark, args)
    complexes = ridership.read_complexes(spark, args.stations).cache()
    if args.command == "scenario-schema":
        index = scenarios.StationIndex.of(ridership.read_platforms(spark, args.stations_individual))
        Path(args.out).write_text(json.dumps(scenarios.json_schema(index), indent=2, ensure_ascii=False) + "\n")
        return Said(f"wrote {args.out}")
    trips, days = spark.read.parquet(args.parquet), pairs.chosen_days(args.day_type, args.days)
    label = analyses.day_label(args.day_type, days, args.days is not None)
    if args.command == "regional-flow":
        name, inside = regional.resolved_region(args.region, args.region_borough, args.region_bbox, args.region_label)
        # the titles of this analysis keep the day type even if days are given
        result = analyses.regional_flow(trips, complexes, (name, inside()), days, args.day_type, command, args.top_n)
    else:
        platforms = ridership.read_platforms(spark, args.stations_individual).cache()
        if args.command == "one-seat-rides":
            result = analyses.one_seat_rides(trips, complexes, platforms, junction(args), assignments(args), days, label, command, args.close_threshold_m, args.top_n)
        else:
            index = scenarios.StationIndex.of(platforms)
            catalogue = scenarios.chosen(scenarios.load(Path(args.scenario_file).read_text(), index), args.category)
            result = analyses.deinterlining(trips, complexes, platforms, scenarios.all_combinations(catalogue), days, label, command, args.close_threshold_m, args.top_n)
    said = [result.summary]
    if args.csv_out:
        path = Path(args.csv_out)
        for suffix, rows in result.rows.items():
            csv_of(rows, str(out := path.with_name(f"{path.stem}{suffix}{path.suffix}")))
            said.append(f"wrote {out}")
    if args.markdown_out:
        Path(args.markdown_out).write_text(result.markdown)
        said.append(f"wrote {args.markdown_out}")
    return Said("\n".join(said), result.markdown)


def junction(args: argparse.Namespace) -> analyses.Junction:
    return analyses.Junction(
        args.boundary_complex_id, args.routes, args.primary_routes or args.routes, args.origin_corridor_a_routes, args.origin_corridor_b_routes,
        args.origin_side, args.dest_side, args.exclude_boundary_dest, args.origin_corridor_a_label, args.origin_corridor_b_label,
    )


def assignments(args: argparse.Namespace) -> list[tuple[str, bool, list[str], list[str]]]:
    """The scenarios that the options ask for: both swaps, one assignment, or today's routing."""
    primary = set(args.primary_routes or args.routes)
    a, b = args.corridor_a_assigned, args.corridor_b_assigned
    if (a is None) != (b is None):
        raise ValueError("give both corridors' routes or none")
    if args.all_corridor_scenarios:
        if a is not None:
            raise ValueError("--all-corridor-scenarios and assigned corridors exclude each other")
        return swap_scenarios(set(args.trunk_a), set(args.trunk_b), primary)
    return [("actual", False, [], [])] if a is None else [("assigned", True, sorted(a), sorted(b))]


def main() -> None:
    spark = SparkSession.builder.appName("tripweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]).summary)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        raise SystemExit(1) from e


if __name__ == "__main__":
    main()
