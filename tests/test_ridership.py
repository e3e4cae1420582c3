"""Ingest, stations, regions, scenario files, walks, command line and stream on small inputs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tripweave import cli
from tripweave.functions import names, routes
from tripweave.operators import boundary, pairs, regional, systemwide, walks
from tripweave.sources import ridership, scenarios
from tripweave.streaming import pairs as streamed
from tripweave.streaming.pairs import current_pairs, running_pairs

HEAD = "Year,Month,Day of Week,Hour of Day,Origin Station Complex ID,Destination Station Complex ID,Estimated Average Ridership"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEAD},Timestamp\n2025,1,Monday,8,1,2,"1,234.5678",x\n2025,1,Saturday,8,1,2,5,x\n')
    (tmp_path / "b.csv").write_text("Destination Station Complex ID,Origin Station Complex ID,Estimated Average Ridership,Hour of Day,Day of Week,Month,Year\n1,3,2.00005,9,Tuesday,2,2025\n4,1,7.5,9,Tuesday,2,2025\n")
    (tmp_path / "stations.csv").write_text(
        "complex_id,stop_name,daytime_routes,latitude,longitude,borough,cbd\n1,Old Name,X,0,0,M,false\n2,North,A,40.80,-73.99,M,true\n3,South Port Authority Bus Terminal,A B,40.60,-73.99,Bk,false\n"
        "1,Middle,B A B,40.70,-73.99,M,true\n4,Remote,,40.90,-73.90,Q,false\n"
    )
    (tmp_path / "platforms.csv").write_text(
        "complex_id,stop_name,daytime_routes,gtfs_latitude,gtfs_longitude,borough,line\n1,Middle,A,40.70,-73.99,M,East\n1,Middle Sq,B,40.7001,-73.99,M,West\n2,North,A,40.80,-73.99,M,East\n3,South,A,40.60,-73.99,Bk,East\n3,South,B,40.6001,-73.99,Bk,West\n"
    )
    return tmp_path


def test_files_are_joined_by_name(spark, files):
    table = ridership.normalised(ridership.read_csv_files(spark, [str(files / "a.csv"), str(files / "b.csv")]))
    got = {(r.origin_id, r.dest_id, r.day_of_week): r.ridership for r in table.collect()}
    assert got == {(1, 2, "Monday"): Decimal("1234.5678"), (1, 2, "Saturday"): Decimal(5), (3, 1, "Tuesday"): Decimal("2.0001"), (1, 4, "Tuesday"): Decimal("7.5")}
    assert table.columns == ["year", "month", "day_of_week", "hour", "origin_id", "dest_id", "ridership"]
    with pytest.raises(ridership.IngestError):
        ridership.normalised(table)
    with pytest.raises(ridership.IngestError):
        ridership.normalised(ridership.read_csv_files(spark, [str(files / "a.csv")]), -1)


def test_patterns_and_folders_are_joined_by_name_too(spark, files):
    want = sorted(map(tuple, ridership.normalised(ridership.read_csv_files(spark, [str(files / "a.csv"), str(files / "b.csv")])).collect()))
    (files / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (files / "in" / name).write_text((files / name).read_text())
    for paths in ([str(files / "[ab].csv")], [str(files / "in")], [str(files / "a.csv"), str(files / "{a,b}.csv")]):
        assert sorted(map(tuple, ridership.normalised(ridership.read_csv_files(spark, paths)).collect())) == want


def test_rounding_goes_away_from_zero(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(12,6)) AS v FROM VALUES (2.5), (-2.5), (0.125) AS t(v)")
    assert [r[0] for r in df.select(ridership.ridership_value(df.v, 0)).collect()] == [3, -3, 0]
    assert df.select(ridership.ridership_value(df.v, 2)).collect()[2][0] == Decimal("0.13")


def test_parquet_is_sorted_and_guarded(spark, files):
    table = ridership.normalised(ridership.read_csv_files(spark, [str(files / "b.csv"), str(files / "a.csv")]))
    out = str(files / "out.parquet")
    assert ridership.write_ridership(table, out, partitions=1) and not ridership.write_ridership(table.limit(0), out)
    back = spark.read.parquet(out)
    assert [(r.origin_id, r.dest_id) for r in back.collect()] == [(1, 2), (1, 2), (1, 4), (3, 1)]
    assert ridership.summary(back) == (4, 202501, 202502)
    assert ridership.write_ridership(table.limit(1), out, force=True) and spark.read.parquet(out).count() == 1


def test_stations(spark, files):
    complexes = {c.complex_id: c for c in ridership.read_complexes(spark, str(files / "stations.csv")).collect()}
    assert complexes[1].name == "Middle" and complexes[1].routes == ["A", "B"] and complexes[1].cbd and complexes[4].routes == []
    assert complexes[3].name == "South PABT"
    assert [p.platform_id for p in ridership.read_platforms(spark, str(files / "platforms.csv")).collect()] == [0, 1, 2, 3, 4]


def test_days(spark):
    assert pairs.chosen_days("saturday") == ("Saturday",) and pairs.chosen_days("all") is None and pairs.chosen_days(days=" Monday ,,tuesday") == ("Monday", "", "tuesday")
    trips = spark.createDataFrame([(2025, 1, "Monday", 1, 2, Decimal(1)), (2025, 2, "Monday", 1, 2, Decimal(2))], "year int, month int, day_of_week string, origin_id int, dest_id int, ridership decimal(9,4)")
    assert pairs.coverage(trips, None) == (2, 202501, 202502) and pairs.coverage(trips, None).label() == "2025-01 to 2025-02"
    with pytest.raises(pairs.DayFilterError):
        pairs.coverage(trips, ("Sunday",))
    with pytest.raises(pairs.UnknownStationError):
        pairs.check_ends(trips, spark.createDataFrame([(1,)], "complex_id int"))


def test_regions(spark, files):
    complexes = ridership.read_complexes(spark, str(files / "stations.csv"))
    inside = lambda *a, **k: {r.complex_id for r in complexes.filter(regional.resolved_region(*a, **k)[1]()).collect()}
    assert inside("cbd") == {1, 2} and inside(boroughs="Bk, Q") == {3, 4} and inside(box="40.6,-74,40.7,-73.9") == {1, 3} and inside("queens") == {4}
    for bad in ({"boroughs": "Bk", "box": "1,1,2,2"}, {"boroughs": "Zz"}, {"box": "1,2,3"}, {"box": "2,1,1,2"}, {"box": "a,b,c,d"}, {"preset": "moon"}):
        with pytest.raises(regional.RegionError):
            regional.resolved_region(**bad)
    with pytest.raises(regional.RegionError):
        regional.check_region(complexes, regional.resolved_region(box="0,0,1,1")[1]())


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_route_sets(spark):
    s = routes.literal_set
    from pyspark.sql import functions as F

    assert evaluate(spark, routes.route_set(F.lit("  B A  B "))) == ["A", "B"] and evaluate(spark, routes.route_set(F.lit(None))) == []
    assert evaluate(spark, routes.with_delta(s("AB"), s("A"), s("AB"))) == ["A"]  # removed first, then added
    assert evaluate(spark, routes.prefer(s("AR"), s("AB"))) == ["A"] and evaluate(spark, routes.prefer(s("R"), s("AB"))) == ["R"]
    given = lambda r: evaluate(spark, routes.assigned_routes(s(r), s("BDNQ"), s("DN"), s("BQ"), s("BD"), s("NQ")))
    assert (given("DR"), given("Q"), given("DQ"), given("F")) == (["B", "D", "R"], ["N", "Q"], ["B", "D", "N", "Q"], ["F"])


def test_labels(spark):
    s, label = routes.literal_set, names.changed_label
    from pyspark.sql import functions as F

    n = F.lit("8 Av")
    assert evaluate(spark, label(n, s("N"), n, s("B"))) == "8 Av (N→B)" and evaluate(spark, label(n, s("BQ"), n, s("NQ"))) == "8 Av (B→N,Q)"
    assert evaluate(spark, label(n, s("N"), n, s("BN"))) == "8 Av (N→B,N)" and evaluate(spark, label(n, s("N"), n, s("N"))) == "8 Av (N)"
    assert evaluate(spark, label(n, s("N"), F.lit("9 Av"), s("B"))) == "8 Av (N)→9 Av (B)"
    assert evaluate(spark, names.slug(F.lit("A/C CPW  Express!"))) == "a_c_cpw_express" and evaluate(spark, names.slug(F.lit("//"))) == "scenario"
    assert evaluate(spark, names.month_label(F.lit(202503))) == "2025-03"


def test_boundary_rule(spark):
    s = routes.literal_set
    direct = lambda o, d, partners: evaluate(spark, boundary.one_seat(s(o), s(d), s("BDNQR"), s("BDNQ"), s(partners))[0])
    assert direct("NR", "N", "") and direct("R", "BQR", "DN") and not direct("R", "NR", "DN") and not direct("R", "F", "")
    with pytest.raises(ValueError):
        boundary.check_assignment([("a", True, ["R"], ["B"])], {"B"}, {"B", "R"})


def index():
    platforms = [(1, "East", "Middle", "A"), (1, "West", "Middle", "BD"), (2, "East", "North", "A"), (3, "East", "South", "AB"), (5, "Way", "72 St", "A"), (6, "Way", "72 St", "B")]
    return scenarios.StationIndex([dict(zip(("complex_id", "line", "name", "routes"), p)) for p in platforms])


def entry(name="One", groups=(), own=("A", "B", "D")):
    return {"name": name, "routes": list(own), "overrides": [dict(zip(("line", "stations", "add", "remove"), g)) for g in groups]}


def load(data):
    return scenarios.load(json.dumps(data), index())


@pytest.mark.parametrize(
    ("entries", "said"),
    [
        ([entry(groups=[("East", ["Middle"], ["B"], ["B"])])], "both adds and removes"),
        ([entry("A/C Express"), entry("A C Express")], "told apart"),
        ([entry("Current")], "told apart"),
        ([entry(groups=[("Way", ["72 St"], ["B"], [])])], "names 2 station complexes"),
        ([entry(groups=[("East", ["Middle"], [], ["D"])])], "only serves"),
        ([entry(groups=[("East", ["Nowhere"], ["B"], [])])], "no station"),
        ([entry(groups=[("East", ["Middle"], ["D"], [])], own=("A",))], "not among its routes"),
        ([entry(own=("Z",))], "unknown routes"),
        ([entry(groups=[("East", ["Middle"], ["B"], []), ("East", ["Middle"], [], ["A"]), ("East", ["Middle"], [], ["B"])])], "only serves"),
        ([entry(groups=[("East", ["South"], ["A"], []), ("East", ["South"], [], ["A"])])], "disagree"),
        ([{"name": "x", "routes": ["A"], "other": 1}], "unknown keys"),
        ([{"name": "x", "routes": []}], "empty"),
        ([{"routes": ["A"]}], "missing"),
    ],
)
def test_bad_scenarios(entries, said):
    with pytest.raises(scenarios.ScenarioError, match=said):
        load({"X": entries})


def test_good_scenarios_combine():
    found = load({"X": [entry("One", [("East", ["Middle", "Middle"], ["A", "B"], []), ("East", ["North"], [], [])])], "Y": [entry("Two", [("West", ["Middle"], [], ["D"])])]})
    names_of = [s.name for s in scenarios.all_combinations(found)]
    assert names_of == ["Current", "Two", "One", "One + Two"]
    assert scenarios.all_combinations(found)[3].moves == {(1, "East", "A", 1), (1, "East", "B", 1), (1, "West", "D", -1)}
    clash = load({"X": [entry("One", [("East", ["South"], ["B"], [])])], "Y": [entry("Two", [("East", ["South"], [], ["B"])])]})
    with pytest.raises(scenarios.ScenarioError, match="can't be combined"):
        scenarios.all_combinations(clash)
    with pytest.raises(scenarios.ScenarioError):
        scenarios.chosen(found, [])
    with pytest.raises(scenarios.ScenarioError):
        scenarios.chosen(found, ["Z"])


def test_json5():
    assert scenarios.parse_json5("// c\n{a: [1, 'it\\'s \"x\"', true,], /* d */ \"b\\n\": {},}") == {"a": [1, 'it\'s "x"', True], "b\n": {}}
    for bad in ("{", "[1 2]", "{a 1}", "[1] 2", "{'a': }"):
        with pytest.raises(scenarios.ScenarioError):
            scenarios.parse_json5(bad)


def test_schema_lists_what_there_is():
    group = scenarios.json_schema(index())["additionalProperties"]["items"]["properties"]["overrides"]["items"]["properties"]
    assert group["line"]["enum"] == ["East", "Way", "West"] and "Middle" in group["stations"]["items"]["enum"] and group["add"]["items"]["enum"] == ["A", "B", "D"]


def test_stranded_pairs_are_far(spark, files):
    """A scenario takes an origin's only route; its destination is off the universe: nothing can be measured."""
    complexes, platforms = ridership.read_complexes(spark, str(files / "stations.csv")), ridership.read_platforms(spark, str(files / "platforms.csv"))
    s = [scenarios.Scenario(n, n, n, frozenset("A"), o) for n, o in (("Current", frozenset()), ("None", frozenset({scenarios.Move(2, "East", "A", -1)})))]
    table, overrides = scenarios.frames(spark, s)
    at = walks.platform_routes(platforms, overrides, table, routes.literal_set("A"))
    stations = walks.complex_routes(complexes, at, overrides, table, routes.literal_set("A"))
    ends = walks.station_ends(stations, walks.nearest(walks.walk_points(complexes, platforms), at, stations), platforms)
    found = spark.createDataFrame([(2, 4, Decimal(100)), (2, 1, Decimal(1)), (1, 3, Decimal(1))], "origin_id int, dest_id int, ridership decimal(9,4)")
    rows = {(r.scenario, r.origin_id, r.dest_id): r for r in systemwide.classified(found, ends, systemwide.scope(stations)).collect()}
    assert rows["None", 2, 4].outcome == "far" and rows["None", 2, 4].walk is None and rows["Current", 2, 4].walk is not None
    assert rows["Current", 2, 1].outcome == "direct" and rows["None", 2, 1].outcome == "far" and rows["None", 2, 1].walk.at_origin
    assert rows["Current", 1, 3].origin_station == "Middle" and not rows["Current", 2, 4].both_ends and rows["None", 2, 1].both_ends


def test_commands(spark, files):
    run = lambda *a: cli.run(spark, list(map(str, a)))
    say = lambda *a: run(*a).report
    out = files / "trips.parquet"
    tables = ("--stations-url", (files / "stations.csv").as_uri(), "--stations-individual-url", (files / "platforms.csv").as_uri(), "--stations-out", files / "got" / "s.csv", "--stations-individual-out", files / "got" / "i.csv")
    assert "4 rows" in run("prepare", files / "[ab].csv", "--out", out, *tables).summary
    assert run("prepare", files / "a.csv", "--out", out, *tables).summary.count("already") == 3
    assert run("prepare", "--stations-only", *tables).summary.count("wrote") == 2
    assert (files / "got" / "s.csv").read_text() == (files / "stations.csv").read_text()
    with pytest.raises(ridership.IngestError):
        run("prepare", "--csv", files / "none*.csv", "--out", files / "other.parquet", *tables)
    base = ("--parquet", out, "--stations", files / "stations.csv")
    text = say("regional-flow", *base, "--csv-out", files / "flow.csv", "--markdown-out", files / "flow.md")
    assert "| Inside→Inside | 617 |" in text and (files / "flow.md").read_text() == text
    assert spark.read.option("header", True).csv(str(files / "flow.csv")).columns == ["origin_id", "origin_name", "dest_id", "dest_name", "riders", "origin_in", "dest_in"]
    more = (*base, "--stations-individual", files / "platforms.csv")
    text = say("one-seat-rides", *more, "--boundary-complex-id", 1, "--routes", "A,B", "--origin-side", "either", "--all-corridor-scenarios", "--trunk-a", "A", "--trunk-b", "B", "--origin-corridor-a-routes", "A", "--origin-corridor-b-routes", "B", "--csv-out", files / "seat.csv")
    assert "## Scenario Comparison" in text and text.count("### Top 25 Destination Stations") == 3
    assert {p.name for p in files.glob("seat*")} == {"seat_actual.csv", "seat_a.csv", "seat_b.csv"}
    (files / "s.json5").write_text("{X: [{name: 'No A', routes: ['A', 'B'], overrides: [{line: 'East', remove: ['A'], stations: ['Middle']},]}]}")
    text = say("deinterlining", *more, "--scenario-file", files / "s.json5", "--category", "X", "--csv-out", files / "d.csv")
    assert "### What Changed, against Current" in text and "- Lost:" in text and "## No A" in text
    stations = text[text.index("### Biggest Changes by Station") :]
    assert "Middle (A,B→B)" in stations or "Middle (A→B)" in stations or "→" in stations  # named by what the scenario does there
    columns = spark.read.option("header", True).csv(str(files / "d_no_a.csv")).columns
    assert columns == "origin_id origin_station origin_routes destination_id destination_station destination_routes riders both_ends one_seat walk_close walk_dist_m walk_station walk_at_origin".split()
    say("scenario-schema", "--stations", files / "stations.csv", "--stations-individual", files / "platforms.csv", "--out", files / "schema.json")
    assert json.loads((files / "schema.json").read_text())["type"] == "object"
    one = run("one-seat-rides", *more, "--boundary-complex-id", 1, "--routes", "A,B", "--origin-side", "either", "--origin-corridor-a-routes", "X", "--origin-corridor-b-routes", "Y", "--trunk-a", "A", "--trunk-b", "B")
    assert "## Headline Numbers" in one.report and "## Scenario Comparison" not in one.report and "## Notes on Reading These Tables" in one.report
    assert "warning" not in one.summary and "one-seat=" in one.summary
    moved = run("one-seat-rides", *more, "--boundary-complex-id", 1, "--routes", "A,B", "--origin-side", "either", "--origin-corridor-a-routes", "X", "--origin-corridor-b-routes", "Y", "--corridor-a-assigned", "A", "--corridor-b-assigned", "B")
    assert "on neither corridor" in moved.summary
    with pytest.raises(ValueError):
        say("one-seat-rides", *more, "--boundary-complex-id", 1, "--corridor-a-assigned", "A")
    with pytest.raises(pairs.UnknownStationError):
        say("one-seat-rides", *more, "--boundary-complex-id", 99)


def test_stream_equals_batch(spark, tmp_path):
    schema = "year int, month int, day_of_week string, hour int, origin_id int, dest_id int, ridership decimal(9,4)"
    trips = spark.createDataFrame([(2025, 1, d, 1, o, 2, Decimal(o)) for d in ("Monday", "Sunday") for o in (1, 2, 1)], schema)
    trips.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = lambda: running_pairs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), pairs.WEEKDAYS, out, str(tmp_path / "c"))
    stream().awaitTermination()
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(current_pairs(spark, out)) == order(pairs.pair_sums(trips, pairs.WEEKDAYS))
    trips.filter("origin_id = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream().awaitTermination()  # goes on where it was
    assert order(current_pairs(spark, out)) == order(pairs.pair_sums(trips.unionAll(trips.filter("origin_id = 1")), pairs.WEEKDAYS))


def test_versions_are_whole_and_batches_count_once(spark, tmp_path, monkeypatch):
    out, order = str(tmp_path / "out"), lambda df: sorted((r.origin_id, r.dest_id, int(r.ridership)) for r in df.collect())
    changes = lambda *rows: spark.createDataFrame(rows, "origin_id int, dest_id int, ridership long")
    assert current_pairs(spark, out).count() == 0
    first = [(i, j, 1) for i in range(6) for j in range(6)]
    streamed.merged(changes(*first), 0, out, 4)
    reader = current_pairs(spark, out)
    with monkeypatch.context() as m:  # the driver dies before the manifest is there
        m.setattr(streamed, "published", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            streamed.merged(changes((0, 0, 9), (7, 7, 9)), 1, out, 4)
    assert order(reader) == order(current_pairs(spark, out)) == first  # neither sees half of a version
    streamed.merged(changes((0, 0, 5), (7, 7, 2)), 1, out, 4)  # the batch is run again
    want = sorted([(0, 0, 5), *first[1:], (7, 7, 2)])
    assert order(current_pairs(spark, out)) == want and order(reader) == first
    streamed.merged(changes((0, 0, 100)), 1, out, 4)  # a batch that is there counts once
    assert order(current_pairs(spark, out)) == want
    for batch in range(2, 7):
        streamed.merged(changes((5, 5, batch)), batch, out, 4)
    assert dict(((o, d), r) for o, d, r in order(current_pairs(spark, out)))[5, 5] == 6
    assert len(streamed.versions(spark, out)) == streamed.KEPT and {n for v in streamed.versions(spark, out) for n in streamed.folders(spark, out, v).values()} == {p.name for p in (tmp_path / "out").glob("batch=*")}


def test_changes_are_checked_and_combined_by_joins(spark):
    from tripweave.sources import changes

    platforms = spark.createDataFrame(
        [(1, "72 St", "Broadway", ["A", "B"]), (2, "72 St", "Broadway", ["B"]), (3, "8 Av", "Sea Beach", ["N"]), (3, "8 Av", "West End", ["D"]), (4, "9 Av", "West End", ["D"]), (4, "9 Av (upper)", "West End", ["D", "W"])],
        "complex_id int, name string, line string, routes array<string>",
    )
    columns = "category string, scenario string, line string, station string, route string, sign int"
    rows = [
        ("X", "ambiguous", "Broadway", "72 St", "B", -1), ("X", "none", "Broadway", "73 St", "B", 1), ("X", "line", "Sea Beach", "8 Av", "D", -1), ("X", "good", "West End", "8 Av", "D", -1),
        ("X", "good", "West End", "8 Av", "B", 1), ("Y", "torn", "West End", "9 Av", "D", -1), ("Y", "torn", "West End", "9 Av (upper)", "D", 1), ("Y", "same", "West End", "8 Av", "B", -1),
    ]
    wanted = spark.createDataFrame(rows, columns)
    got = {(r.scenario, r.station, r.fault) for r in changes.faults(wanted, platforms).collect()}
    assert got == {("ambiguous", "72 St", "ambiguous"), ("none", "73 St", "no station"), ("line", "8 Av", "not served"), ("torn", "9 Av", "both"), ("torn", "9 Av (upper)", "both"), ("same", "8 Av", "not served")}
    good = wanted.filter("scenario IN ('good', 'same')")
    both = changes.combinations(good.select("category", "scenario", F.upper("scenario").alias("description")))
    assert {(r.name, r.description, r.category) for r in both.collect()} == {("Current", "today's routes", "Current"), ("good", "GOOD", "X"), ("same", "SAME", "Y"), ("good + same", "GOOD + SAME", "X + Y")}
    placed = changes.placed_changes(good, platforms)
    assert changes.disagreements(placed).count() == 0  # each alone is fine
    joint = both.select(F.col("name").alias("combination"), F.explode("parts").alias("scenario")).join(placed, "scenario")
    assert [tuple(r) for r in changes.disagreements(joint, "combination").collect()] == [("good + same", 3, "West End", "B")]
    moves = {(r.scenario, r.complex_id, r.line): (r["add"], r["remove"]) for r in changes.combined_moves(placed, both.filter("name <> 'good + same'")).collect()}
    assert moves == {("good", 3, "West End"): (["B"], ["D"]), ("same", 3, "West End"): ([], ["B"])}
    assert changes.combinations(good.limit(0).select("category", "scenario", F.lit("").alias("description"))).count() == 1


def test_structs_are_flattened_into_one_file(spark, tmp_path):
    from tripweave.plans.reports import csv_of, flattened

    df = spark.createDataFrame([(1, ((2, ["a", "b"]), None), 'say "x", y'), (3, None, "")], "a int, b struct<c:struct<d:int,e:array<string>>,f:string>, g string")
    assert flattened(df).columns == ["a", "b_c_d", "b_c_e", "b_f", "g"]
    out = tmp_path / "rows.csv"
    for _ in range(2):  # the second takes the first one's place
        csv_of(df.repartition(2), str(out))
        assert out.is_file() and {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {"rows.csv"}
    lines = out.read_text().splitlines()
    assert lines[0] == "a,b_c_d,b_c_e,b_f,g" and sorted(lines[1:])[0] == '1,2,"a,b",,"say ""x"", y"' and len(lines) == 3
    with pytest.raises(ValueError, match="clash"):
        flattened(spark.createDataFrame([(1, (2,))], "a_b int, a struct<b:int>"))


def test_summary_and_coverage_are_observed_by_the_scan_itself(spark, tmp_path):
    schema = "year int, month int, day_of_week string, hour int, origin_id int, dest_id int, ridership decimal(9,4)"
    trips = spark.createDataFrame([(2024 + i % 2, 1 + i % 12, ("Monday", "Sunday")[i % 3 % 2], i % 24, i % 7, i % 5, Decimal(i)) for i in range(500)], schema).repartition(5)
    out = str(tmp_path / "t")
    assert ridership.write_ridership(trips, out, partitions=3) == ridership.summary(spark.read.parquet(out)) == (500, 202401, 202512)
    table = spark.read.parquet(out)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("observed", "")
    sums, cover = pairs.counted_pairs(table, pairs.WEEKDAYS)
    spark.sparkContext.setJobGroup("other", "")
    assert cover == pairs.coverage(table, pairs.WEEKDAYS) and 0 < jobs() <= 3
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, pairs.pair_sums(table, pairs.WEEKDAYS).collect()))
    with pytest.raises(pairs.DayFilterError):
        pairs.counted_pairs(table, ("Friday",))


def test_row_groups_of_other_stations_are_skipped(spark, tmp_path):
    """Row groups that the table's order and statistics rule out are never read."""
    from pyspark.sql import functions as F

    trips = spark.range(60_000).select(
        F.lit(2025).alias("year"), F.lit(1).alias("month"), F.lit("Monday").alias("day_of_week"), (F.col("id") % 24).cast("int").alias("hour"),
        (F.col("id") % 300 * 2).cast("int").alias("origin_id"), (F.col("id") % 301).cast("int").alias("dest_id"), F.lit(1).cast("decimal(9,4)").alias("ridership"),
    )
    out = str(tmp_path / "t")
    ridership.write_ridership(trips, out, partitions=6)

    def read(condition) -> int:
        df = spark.read.parquet(out).filter(condition)
        df.collect()
        scans = df._jdf.queryExecution().executedPlan().collectLeaves()
        return scans.apply(0).metrics().apply("numOutputRows").value()

    everything, one = read("origin_id >= 0"), read("origin_id = 150")
    assert everything == 60_000 and 200 <= one <= 60_000 / 5
    assert read("origin_id = 151") == 0  # within a group's range, but not in its bloom filter or dictionary


def test_fetch_keeps_what_is_there(files):
    from tripweave.sources.fetch import fetch_csv

    url, out = (files / "stations.csv").as_uri(), str(files / "new" / "s.csv")
    assert fetch_csv(url, out) == 5 and fetch_csv(url, out) is None and fetch_csv(url, out, force=True) == 5
