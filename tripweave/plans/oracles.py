"""The queries once more in SQL: one chain of common table expressions, and what each query selects from it."""

from __future__ import annotations

from .model import BOUNDARY_ID, BOUNDARY_LAT, CLOSE_M, PRIMARY, TRUNK_A, TRUNK_B, UNIVERSE
from .queries import BOROUGHS, BOX


def _set(routes) -> str:
    return "[" + ", ".join(f"'{r}'" for r in sorted(routes)) + "]"


U, P, TA, TB = map(_set, (UNIVERSE, PRIMARY, TRUNK_A, TRUNK_B))
_DIST = """2 * 6371000 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""
_OVER = "(SELECT n_days FROM cov)"


def _avg(total: str) -> str:
    return f"round(CAST(coalesce({total}, 0) AS DOUBLE) / {_OVER}, 6)"


def _meet(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_intersect({a}, {b})))"


def _minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def _show(name: str, routes: str) -> str:
    return f"{name} || ' (' || array_to_string(list_sort({routes}), ',') || ')'"


def _given(assigned: str) -> str:
    return f"list_sort(list_distinct(list_concat({_minus('routes', P)}, {_meet(assigned, P)})))"


CHAIN = f"""WITH platforms AS (
  SELECT CAST(s_suppkey AS INTEGER) AS platform_id, s_nationkey AS complex_id, s_name AS name, 'L' || (s_suppkey % 5) AS line, r_name AS borough,
    list_sort(list_distinct(list_filter([substr('ABCDEFGH', CAST((s_nationkey * 3 + s_suppkey % 5) % 16 + 1 AS INTEGER), 1), substr('ABCDEFGH', CAST((s_nationkey * 5 + s_suppkey % 5 * 2) % 24 + 1 AS INTEGER), 1)], lambda x: x <> ''))) AS routes,
    CAST(40.5 AS DOUBLE) + (s_suppkey * 41 % 100) * CAST(0.004 AS DOUBLE) AS lat, CAST(-74.2 AS DOUBLE) + (s_suppkey * 59 % 100) * CAST(0.005 AS DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
complexes AS (
  SELECT n_nationkey AS complex_id, n_name AS name, r_name AS borough, n_nationkey % 3 = 0 AS cbd, coalesce(r.routes, CAST([] AS VARCHAR[])) AS routes,
    CAST(40.5 AS DOUBLE) + (n_nationkey * 37 % 100) * CAST(0.004 AS DOUBLE) AS lat, CAST(-74.2 AS DOUBLE) + (n_nationkey * 53 % 100) * CAST(0.005 AS DOUBLE) AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT complex_id AS c, list_sort(list_distinct(flatten(list(routes)))) AS routes FROM platforms GROUP BY 1) r ON c = n_nationkey),
trips AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, dayname(l_shipdate) AS day_of_week, l_linenumber AS hour,
    s_nationkey AS origin_id, c_nationkey AS dest_id, CAST(l_quantity AS DECIMAL(9,4)) AS ridership
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
weekdays AS (SELECT * FROM trips WHERE day_of_week IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday')),
cov AS (SELECT count(*) AS n_days, min(m) AS first_month, max(m) AS last_month FROM (SELECT DISTINCT year * 100 + month AS m, day_of_week FROM weekdays)),
pairs AS (SELECT origin_id, dest_id, sum(ridership) AS ridership FROM weekdays GROUP BY 1, 2),
scenarios AS (SELECT unnest(['Current', 'Swap']) AS scenario),
pr AS (
  SELECT scenario, platform_id, complex_id, line, name, lat, lon, routes AS real_routes,
    {_meet(f"CASE WHEN scenario = 'Swap' AND line IN ('L1', 'L2') THEN list_concat({_minus('routes', _set('A'))}, ['C']) ELSE routes END", U)} AS routes
  FROM platforms, scenarios),
sr AS (
  SELECT scenario, c.complex_id, c.name, lat, lon, coalesce(u.routes, CAST([] AS VARCHAR[])) AS routes
  FROM complexes c CROSS JOIN scenarios LEFT JOIN (SELECT scenario, complex_id, list_sort(list_distinct(flatten(list(routes)))) AS routes FROM pr GROUP BY 1, 2) u USING (scenario, complex_id)),
own AS (
  SELECT sr.scenario, sr.complex_id, list_distinct(list(p.name)) AS names FROM sr JOIN platforms p ON p.complex_id = sr.complex_id
  WHERE len(list_intersect(p.routes, sr.routes)) > 0 GROUP BY 1, 2),
ends AS (
  SELECT scenario, complex_id, CASE WHEN len(names) = 1 THEN names[1] ELSE name END AS station, routes FROM sr LEFT JOIN own USING (scenario, complex_id)),
points AS (
  SELECT c.complex_id, CAST(coalesce(p.platform_id, 1000000 + c.complex_id) AS INTEGER) AS point, p.platform_id, coalesce(p.lat, c.lat) AS lat, coalesce(p.lon, c.lon) AS lon
  FROM complexes c LEFT JOIN platforms p ON p.complex_id = c.complex_id),
marked AS (
  SELECT s.scenario, o.*, coalesce(len(pr.routes), 0) > 0 AS serves FROM scenarios s CROSS JOIN points o LEFT JOIN pr ON pr.scenario = s.scenario AND pr.platform_id = o.platform_id),
stand AS (SELECT * FROM marked QUALIFY serves OR NOT bool_or(serves) OVER (PARTITION BY scenario, complex_id)),
reach AS (SELECT a.scenario, a.complex_id, unnest(b.routes) AS route, {_DIST.format(a="a", b="b")} AS dist_m, a.point, b.platform_id AS platform, b.complex_id AS to_complex FROM stand a JOIN pr b ON a.scenario = b.scenario),
near AS (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY scenario, complex_id, route ORDER BY dist_m, point, platform) = 1),
nd AS (SELECT complex_id, route FROM near GROUP BY 1, 2 HAVING count(*) < 2 OR count(DISTINCT (dist_m, point, platform, to_complex)) > 1),
es AS (SELECT a.complex_id, a.station <> b.station OR a.routes <> b.routes AS moved FROM ends a JOIN ends b USING (complex_id) WHERE a.scenario = 'Swap' AND b.scenario = 'Current'),
scope AS (SELECT DISTINCT complex_id FROM sr WHERE len(routes) > 0),
base AS (
  SELECT o.scenario, p.origin_id, p.dest_id, p.ridership, o.station AS o_station, o.routes AS o_routes, d.station AS d_station, d.routes AS d_routes,
    p.origin_id IN (SELECT complex_id FROM scope) AND p.dest_id IN (SELECT complex_id FROM scope) AS both_ends, len(list_intersect(o.routes, d.routes)) > 0 AS one_seat
  FROM pairs p JOIN ends o ON o.complex_id = p.origin_id JOIN ends d ON d.complex_id = p.dest_id AND d.scenario = o.scenario
  WHERE p.origin_id IN (SELECT complex_id FROM scope) OR p.dest_id IN (SELECT complex_id FROM scope)),
options AS (
  SELECT b.scenario, b.origin_id, b.dest_id, n.dist_m, FALSE AS at_origin, n.route, n.point, n.platform, n.to_complex FROM base b JOIN near n ON n.scenario = b.scenario AND n.complex_id = b.dest_id AND list_contains(b.o_routes, n.route)
  UNION ALL
  SELECT b.scenario, b.origin_id, b.dest_id, n.dist_m, TRUE, n.route, n.point, n.platform, n.to_complex FROM base b JOIN near n ON n.scenario = b.scenario AND n.complex_id = b.origin_id AND list_contains(b.d_routes, n.route)),
walk AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY scenario, origin_id, dest_id ORDER BY dist_m, at_origin, route, point, platform) = 1),
rows AS (
  SELECT b.*, w.dist_m, w.at_origin, w.to_complex, NOT one_seat AND coalesce(w.dist_m <= {CLOSE_M}, FALSE) AS close,
    CASE WHEN one_seat THEN 'direct' WHEN w.dist_m <= {CLOSE_M} THEN 'close' ELSE 'far' END AS outcome
  FROM base b LEFT JOIN walk w USING (scenario, origin_id, dest_id)),
both_rows AS (SELECT * FROM rows WHERE both_ends),
moves AS (
  SELECT a.scenario, a.origin_id, a.dest_id, a.ridership, b.outcome AS before, a.outcome AS after, b.o_station AS o_was, b.o_routes AS o_had, b.d_station AS d_was, b.d_routes AS d_had, a.o_station, a.o_routes, a.d_station, a.d_routes
  FROM both_rows a JOIN both_rows b USING (origin_id, dest_id) WHERE a.scenario = 'Swap' AND b.scenario = 'Current'),
folded AS (
  SELECT scenario, before, after, origin_id, dest_id, o_was, o_had, d_was, d_had, o_station, o_routes, d_station, d_routes, sum(ridership) OVER w AS ridership
  FROM moves WHERE before <> after
  WINDOW w AS (PARTITION BY before, after, least(origin_id, dest_id), greatest(origin_id, dest_id))
  QUALIFY row_number() OVER (PARTITION BY before, after, least(origin_id, dest_id), greatest(origin_id, dest_id) ORDER BY moves.ridership DESC, origin_id) = 1),
starts AS (SELECT * FROM complexes WHERE len(list_intersect(routes, {U})) > 0 AND lat < CAST({BOUNDARY_LAT!r} AS DOUBLE)),
scoped AS (
  SELECT p.* FROM pairs p JOIN complexes d ON d.complex_id = p.dest_id
  WHERE p.origin_id IN (SELECT complex_id FROM starts) AND (p.dest_id = {BOUNDARY_ID} OR d.lat > CAST({BOUNDARY_LAT!r} AS DOUBLE))),
on_line AS (SELECT line, borough, list_distinct(flatten(list(routes))) AS on_line FROM platforms GROUP BY 1, 2),
partners AS (SELECT complex_id, {_meet("flatten(list(on_line))", P)} AS partners FROM platforms JOIN on_line USING (line, borough) GROUP BY 1),
assignments AS (SELECT * FROM (VALUES ('actual', FALSE, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])), ('a', TRUE, {_set(TRUNK_A & PRIMARY)}, {_set(TRUNK_B & PRIMARY)}), ('b', TRUE, {_set(TRUNK_B & PRIMARY)}, {_set(TRUNK_A & PRIMARY)})) t(scenario, active, to_a, to_b)),
eff AS (
  SELECT scenario, complex_id, name, routes, CASE WHEN NOT active THEN routes
    WHEN len(list_intersect(routes, {TA})) > 0 AND len(list_intersect(routes, {TB})) > 0 THEN {_given("list_concat(to_a, to_b)")}
    WHEN len(list_intersect(routes, {TA})) > 0 THEN {_given("to_a")} WHEN len(list_intersect(routes, {TB})) > 0 THEN {_given("to_b")} ELSE routes END AS effective
  FROM starts, assignments),
serves AS (SELECT a.scenario, c.complex_id, coalesce(e.effective, c.routes) AS serves FROM complexes c CROSS JOIN assignments a LEFT JOIN eff e ON e.scenario = a.scenario AND e.complex_id = c.complex_id),
wanted AS (SELECT DISTINCT scenario, {_meet("effective", U)} AS wanted FROM eff),
bnear AS (
  SELECT w.scenario, w.wanted, a.complex_id AS dest_id, {_DIST.format(a="a", b="b")} AS walk_m, b.complex_id AS to_complex
  FROM wanted w JOIN serves s ON s.scenario = w.scenario AND len(list_intersect(s.serves, w.wanted)) > 0 JOIN platforms b ON b.complex_id = s.complex_id CROSS JOIN points a
  QUALIFY row_number() OVER (PARTITION BY w.scenario, w.wanted, a.complex_id ORDER BY {_DIST.format(a="a", b="b")}, a.point, b.platform_id) = 1),
cross0 AS (
  SELECT e.scenario, p.origin_id, p.dest_id, p.ridership, e.name AS o_name, e.effective, coalesce(x.partners, CAST([] AS VARCHAR[])) AS partners, d.name AS d_name, d.routes AS d_routes,
    {_meet("e.effective", U)} AS wanted, list_sort(list_intersect(list_intersect(e.effective, d.routes), {U})) AS shared
  FROM scoped p JOIN eff e ON e.complex_id = p.origin_id JOIN complexes d ON d.complex_id = p.dest_id LEFT JOIN partners x ON x.complex_id = p.origin_id),
cross1 AS (SELECT *, len(shared) > 0 AND (len(list_intersect(shared, {P})) > 0 OR len(list_intersect(d_routes, partners)) = 0) AS one_seat FROM cross0),
cross2 AS (
  SELECT c.*, n.walk_m, t.name || ' (' || array_to_string({_meet("t.routes", U)}, ',') || ')' AS walk_to,
    CASE WHEN len(list_intersect(shared, {P})) > 0 THEN {_meet("shared", P)} ELSE shared END AS ridden,
    CASE WHEN NOT one_seat AND n.walk_m = 0 THEN {_meet("partners", "d_routes")} ELSE CAST([] AS VARCHAR[]) END AS exit_routes
  FROM cross1 c LEFT JOIN bnear n ON n.scenario = c.scenario AND n.wanted = c.wanted AND n.dest_id = c.dest_id LEFT JOIN complexes t ON t.complex_id = n.to_complex),
crossings AS (
  SELECT *, one_seat OR coalesce(walk_m <= {CLOSE_M}, FALSE) AS close, CASE WHEN one_seat THEN 0.0 ELSE walk_m END AS dist_m, CASE WHEN one_seat THEN ridden ELSE exit_routes END AS arrival,
    {_show("o_name", "CASE WHEN one_seat THEN ridden ELSE wanted END")} AS origin_name,
    {_show("d_name", f"CASE WHEN one_seat THEN ridden WHEN len(exit_routes) > 0 THEN exit_routes WHEN len(list_intersect(list_intersect(d_routes, {U}), {P})) > 0 THEN list_intersect(list_intersect(d_routes, {U}), {P}) ELSE list_intersect(d_routes, {U}) END")} AS dest_name
  FROM cross2)
"""  # noqa: E501


def _list(c: str) -> str:
    return f"array_to_string({c}, ',')"


def _quadrants(inside: str) -> str:
    s = lambda c: _avg(f"sum(ridership) FILTER ({c})")
    return f"""SELECT {_avg('sum(ridership)')} AS total, {s('o AND d')} AS in_in, {s('o AND NOT d')} AS in_out, {s('NOT o AND d')} AS out_in, {s('NOT o AND NOT d')} AS out_out,
  {s('o <> d')} AS inter, {s('o = d')} AS intra
FROM (SELECT ridership, {inside.format('a')} AS o, {inside.format('b')} AS d FROM pairs JOIN complexes a ON a.complex_id = origin_id JOIN complexes b ON b.complex_id = dest_id)"""


_STATS = f"""{_avg('sum(ridership)')} AS total, {_avg('sum(ridership) FILTER (one_seat)')} AS one_seat, {_avg("sum(ridership) FILTER (outcome = 'close')")} AS close,
  {_avg("sum(ridership) FILTER (outcome <> 'far')")} AS effective"""


def _label(was: str, had: str, now: str, has: str) -> str:
    lost = _minus(had, has)
    return f"""CASE WHEN {was} = {now} AND {had} = {has} THEN {_show(was, had)}
  WHEN {was} = {now} THEN {was} || ' (' || {_list(f"CASE WHEN len({lost}) > 0 THEN {lost} ELSE {had} END")} || '→' || {_list(has)} || ')'
  ELSE {_show(was, had)} || '→' || {_show(now, has)} END"""


_PAIR = f"SELECT origin_id, dest_id, {_avg('ridership')} AS riders FROM "
_BOX = f"{{0}}.lat BETWEEN {BOX[0]} AND {BOX[2]} AND {{0}}.lon BETWEEN {BOX[1]} AND {BOX[3]}"
FINAL = {
    "ingest_normalize": "SELECT year, month, day_of_week, hour, origin_id, dest_id, CAST(CAST(round(CAST(ridership AS DECIMAL(18,6)) / 3, 2) AS DECIMAL(9,4)) AS DOUBLE) AS ridership FROM trips",
    "day_coverage": "SELECT * FROM cov",
    "od_pairs": _PAIR + "pairs",
    "od_pairs_scoped": _PAIR + "pairs WHERE origin_id IN (SELECT complex_id FROM scope) OR dest_id IN (SELECT complex_id FROM scope)",
    "od_pairs_origin_semi": _PAIR + "pairs WHERE origin_id IN (SELECT complex_id FROM starts)",
    "region_cbd_quadrants": _quadrants("{0}.cbd"),
    "region_borough_quadrants": _quadrants("{0}.borough IN (" + ", ".join(f"'{b}'" for b in BOROUGHS) + ")"),
    "region_bbox_quadrants": _quadrants(_BOX),
    "regional_top_pairs": f"""SELECT origin_id, a.name AS origin_name, dest_id, b.name AS dest_name, {_avg('ridership')} AS riders, a.cbd AS origin_in, b.cbd AS dest_in,
  CASE WHEN a.cbd THEN 'in' ELSE 'out' END || '→' || CASE WHEN b.cbd THEN 'in' ELSE 'out' END AS flow
FROM pairs JOIN complexes a ON a.complex_id = origin_id JOIN complexes b ON b.complex_id = dest_id ORDER BY riders DESC, origin_id, dest_id LIMIT 25""",
    "route_sets": f"SELECT complex_id, {_list('routes')} AS routes, CAST(len(routes) AS INTEGER) AS n_routes FROM complexes",
    "platform_narrowed_name": f"SELECT scenario, complex_id, station, {_list('routes')} AS routes FROM ends",
    "walk_points": "SELECT complex_id, point, coalesce(platform_id, -1) AS platform_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points",
    "scenario_routes": f"SELECT scenario, platform_id, complex_id, line, {_list('real_routes')} AS real_routes, {_list('routes')} AS routes FROM pr",
    "scenario_product": """SELECT coalesce(nullif(concat_ws(' + ', a.s, b.s), ''), 'Current') AS name, coalesce(nullif(concat_ws(' + ', a.d, b.d), ''), 'today''s routes') AS description,
  coalesce(nullif(concat_ws(' + ', a.line, b.line), ''), 'Current') AS category
FROM (SELECT DISTINCT line, r || ' off ' || line AS s, line || ' without ' || r AS d FROM (SELECT line, unnest(routes) AS r FROM platforms WHERE line = 'L1') UNION ALL SELECT NULL, NULL, NULL) a
CROSS JOIN (SELECT DISTINCT line, r || ' off ' || line AS s, line || ' without ' || r AS d FROM (SELECT line, unnest(routes) AS r FROM platforms WHERE line = 'L2') UNION ALL SELECT NULL, NULL, NULL) b""",
    "scenario_faults": """SELECT DISTINCT 'No A' AS scenario, w.line, w.station, 'A' AS route, fault FROM (
  SELECT l AS line, name AS station, bool_or(platform_id % 2 = 1) AS adds FROM platforms, (VALUES ('L1'), ('L2')) v(l) WHERE line = 'L1' GROUP BY 1, 2) w
LEFT JOIN (SELECT name, line, count(DISTINCT complex_id) AS n, min(complex_id) AS c FROM platforms GROUP BY 1, 2) k ON k.name = w.station AND k.line = w.line
LEFT JOIN (SELECT complex_id, line, bool_or(list_contains(routes, 'A')) AS has FROM platforms GROUP BY 1, 2) h ON h.complex_id = k.c AND h.line = w.line
LEFT JOIN (SELECT complex_id, line, bool_or(platform_id % 2 = 1) AS adds FROM platforms WHERE line = 'L1' GROUP BY 1, 2) t ON t.complex_id = k.c AND t.line = w.line
CROSS JOIN (VALUES ('no station'), ('ambiguous'), ('not served'), ('both')) f(fault)
WHERE CASE fault WHEN 'no station' THEN n IS NULL WHEN 'ambiguous' THEN n > 1 WHEN 'not served' THEN n = 1 AND NOT coalesce(has, FALSE) ELSE n = 1 AND coalesce(t.adds, FALSE) END""",
    "station_lookup": "SELECT DISTINCT name, line, complex_id FROM platforms",
    "scenario_moves": """SELECT scenario, complex_id, line, won AS add, lost AS remove FROM (
  SELECT DISTINCT complex_id, line, r.lost, r.won, r.scenario FROM platforms p JOIN (VALUES ('L1', 'A', 'C', 'C for A'), ('L1', 'A', 'C', 'C for A + D for B'), ('L2', 'B', 'D', 'D for B'), ('L2', 'B', 'D', 'C for A + D for B')) r(l, lost, won, scenario)
    ON p.line = r.l AND list_contains(p.routes, r.lost))""",
    "abbreviated_names": """SELECT complex_id, 'Park Pl ' || name || ' Atlantic Av, PABT' AS name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM complexes""",
    "month_labels": "SELECT printf('%d-%02d', year, month) AS month, count(*) AS trips FROM trips GROUP BY year, month",
    "changed_stations": f"""SELECT scenario, complex_id, {_label('was', 'had', 'station', 'routes')} AS name
FROM ends JOIN (SELECT complex_id, station AS was, routes AS had FROM ends WHERE scenario = 'Current') USING (complex_id) WHERE scenario <> 'Current'""",
    "off_corridors": f"SELECT complex_id, name, {_list('routes')} AS routes FROM starts WHERE len(list_intersect(routes, {TA})) = 0 AND len(list_intersect(routes, ['D'])) = 0",
    "one_seat_systemwide": "SELECT scenario, origin_id, dest_id, both_ends, one_seat FROM rows",
    "nearest_platform": "SELECT scenario, complex_id, route, round(dist_m, 3) AS dist_m, platform AS platform_id, to_complex FROM near",
    "shortest_walk": "SELECT r.scenario, origin_id, dest_id, coalesce(round(dist_m, 3), -1) AS dist_m, coalesce(at_origin, FALSE) AS at_origin, close, e.station AS walk_station FROM rows r LEFT JOIN ends e ON e.scenario = r.scenario AND e.complex_id = r.to_complex WHERE NOT one_seat",
    "report_rows": f"""SELECT r.scenario, origin_id, o_station AS origin_station, {_list('o_routes')} AS origin_routes, dest_id AS destination_id, d_station AS destination_station, {_list('d_routes')} AS destination_routes,
  {_avg('ridership')} AS riders, both_ends, one_seat, close AS walk_close, CASE WHEN one_seat THEN 0 ELSE coalesce(round(dist_m, 3), 0) END AS walk_dist_m, CASE WHEN NOT one_seat THEN e.station END AS walk_station, NOT one_seat AND coalesce(at_origin, FALSE) AS walk_at_origin
FROM rows r LEFT JOIN ends e ON e.scenario = r.scenario AND e.complex_id = r.to_complex""",
    "outcomes": f"SELECT scenario, both_ends, outcome, count(*) AS pairs, {_avg('sum(ridership)')} AS riders FROM rows GROUP BY 1, 2, 3",
    "evaluated_pairs": """SELECT scenario, evaluated, count(*) AS pairs FROM (
  SELECT r.scenario, r.scenario = 'Current' OR o.moved OR d.moved
    OR EXISTS (SELECT 1 FROM nd WHERE nd.complex_id = origin_id AND list_contains(r.d_routes, route)) OR EXISTS (SELECT 1 FROM nd WHERE nd.complex_id = dest_id AND list_contains(r.o_routes, route)) AS evaluated
  FROM rows r JOIN es o ON o.complex_id = origin_id JOIN es d ON d.complex_id = dest_id) GROUP BY 1, 2""",
    "rider_stats_both_ends": f"SELECT scenario, {_STATS} FROM both_rows GROUP BY 1",
    "rider_stats_either_end": f"SELECT scenario, {_STATS} FROM rows GROUP BY 1",
    "symmetric_pairs": f"""SELECT scenario, origin_id, dest_id, {_avg('ridership')} AS forward, {_avg('total - ridership')} AS reverse, {_avg('total')} AS riders, outcome
FROM (SELECT *, sum(ridership) OVER (PARTITION BY scenario, least(origin_id, dest_id), greatest(origin_id, dest_id)) AS total,
  row_number() OVER (PARTITION BY scenario, least(origin_id, dest_id), greatest(origin_id, dest_id) ORDER BY ridership DESC, origin_id) AS place FROM both_rows) WHERE place = 1""",
    "origin_stats": f"SELECT scenario, origin_id AS complex_id, o_station AS station, {_STATS} FROM both_rows GROUP BY 1, 2, 3",
    "destination_stats": f"SELECT scenario, dest_id AS complex_id, d_station AS station, {_STATS} FROM both_rows GROUP BY 1, 2, 3",
    "transition_matrix": f"SELECT scenario, before, after, count(*) AS pairs, {_avg('sum(ridership)')} AS riders FROM moves GROUP BY 1, 2, 3",
    "gained_lost_net": f"""SELECT scenario, {_avg("sum(ridership) FILTER (before = 'far' AND after <> 'far')")} AS gained, {_avg("sum(ridership) FILTER (before <> 'far' AND after = 'far')")} AS lost,
  {_avg("coalesce(sum(ridership) FILTER (before = 'far' AND after <> 'far'), 0) - coalesce(sum(ridership) FILTER (before <> 'far' AND after = 'far'), 0)")} AS net FROM moves GROUP BY 1""",
    "changed_pairs_topk": f"""SELECT scenario, CAST(row_number() OVER (ORDER BY riders DESC, before, after, origin_id, dest_id) AS INTEGER) AS place, before, after, origin_id, dest_id, riders, label
FROM (SELECT *, {_avg('ridership')} AS riders, {_label('o_was', 'o_had', 'o_station', 'o_routes')} || ' ↔ ' || {_label('d_was', 'd_had', 'd_station', 'd_routes')} AS label FROM folded) QUALIFY place <= 25""",
    "station_changes": f"""SELECT *, abs(net) AS magnitude FROM (SELECT scenario, complex_id, {_avg('sum(ridership)')} AS total, {_avg("sum(CASE WHEN before = 'far' THEN ridership WHEN after = 'far' THEN -ridership ELSE 0 END)")} AS net
FROM (SELECT *, unnest(list_distinct([origin_id, dest_id])) AS complex_id FROM folded) GROUP BY 1, 2)""",
    "boundary_scope": _PAIR + "scoped",
    "express_partners": f"SELECT complex_id, {_list('partners')} AS partners FROM partners",
    "effective_origin_routes": f"SELECT scenario, complex_id, {_list('routes')} AS routes, {_list('effective')} AS effective FROM eff",
    "one_seat_boundary": f"SELECT scenario, origin_id, dest_id, {_list('effective')} AS origin_routes, {_list('d_routes')} AS dest_routes, one_seat, origin_name, dest_name FROM crossings",
    "walk_boundary": "SELECT scenario, origin_id, dest_id, round(dist_m, 3) AS dist_m, close, CASE WHEN NOT one_seat THEN walk_to END AS near_station FROM crossings",
    "boundary_dest_stats": f"""SELECT scenario, dest_id, CASE WHEN len(arrival) > 0 THEN {_show('plain', 'arrival')} ELSE label END AS name, {_avg('t')} AS total, {_avg('s')} AS one_seat, {_avg('m')} AS xfer, {_avg('c')} AS xfer_close,
  round(100 * CAST(s AS DOUBLE) / CAST(t AS DOUBLE), 6) AS one_seat_pct, CASE WHEN m > 0 THEN round(100 * CAST(c AS DOUBLE) / CAST(m AS DOUBLE), 6) END AS xfer_close_pct, CASE WHEN m > 0 THEN round(w / CAST(m AS DOUBLE), 4) END AS xfer_dist_m
FROM (SELECT scenario, dest_id, sum(ridership) AS t, coalesce(sum(ridership) FILTER (one_seat), 0) AS s, coalesce(sum(ridership) FILTER (NOT one_seat), 0) AS m, coalesce(sum(ridership) FILTER (NOT one_seat AND close), 0) AS c,
  sum(CAST(ridership AS DOUBLE) * dist_m) FILTER (NOT one_seat) AS w, list_distinct(flatten(list(arrival))) AS arrival, min(d_name) AS plain, min(dest_name) AS label FROM crossings GROUP BY 1, 2)""",
    "boundary_origin_stats": f"SELECT e.scenario, e.complex_id, {_avg('sum(ridership)')} AS total, {_avg('sum(ridership) FILTER (one_seat)')} AS one_seat FROM eff e LEFT JOIN crossings c ON c.scenario = e.scenario AND c.origin_id = e.complex_id GROUP BY 1, 2",
    "corridor_swap_comparison": f"""SELECT scenario, {_avg('sum(ridership)')} AS total, {_avg('sum(ridership) FILTER (one_seat)')} AS one_seat, {_avg('sum(ridership) FILTER (NOT one_seat)')} AS xfer,
  {_avg('sum(ridership) FILTER (NOT one_seat AND close)')} AS close, {_avg('sum(ridership) FILTER (close)')} AS effective FROM crossings GROUP BY 1""",
}  # noqa: E501


def oracle_sql() -> dict[str, str]:
    return {name: CHAIN + final for name, final in FINAL.items()}
