"""The systemwide analysis: every pair under every scenario, and what changes between two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bitmaps
from ..functions.names import changed_label, outcome
from .grid import if_small
from .pairs import average

CLOSE_M = 300.0
OUTCOMES = ("direct", "close", "far")


def scope(stations: DataFrame) -> DataFrame:
    """complex_id of stations with a route of the universe under any scenario."""
    return stations.filter(F.size("routes") > 0).select("complex_id").distinct()


ROW = ("scenario", "origin_id", "dest_id", "ridership", "origin_station", "origin_routes", "dest_station", "dest_routes", "both_ends", "one_seat", "walk", "close", "outcome", "evaluated")


def station_table(ends: DataFrame, in_scope: DataFrame, known: list[str]) -> DataFrame:
    """``ends`` with ``hit`` (in scope), the routes as a mask, and a column ``near_<bit>`` with the nearest platform of each route of the dictionary."""
    hit = in_scope.withColumn("hit", F.lit(True))
    nearest_of = lambda route: F.get(F.filter("near", lambda x: x["route"] == route), F.lit(0))
    nearest = [nearest_of(r).alias(f"near_{i}") for i, r in enumerate(known)]
    return ends.join(if_small(hit), "complex_id", "left").select("scenario", "complex_id", "station", "routes", F.coalesce("hit", F.lit(False)).alias("hit"), bitmaps.mask(F.col("routes"), known).alias("mask"), *nearest)


def evaluated(pairs: DataFrame, table: DataFrame, known: list[str], close_m: float = CLOSE_M) -> DataFrame:
    """Pairs under every scenario of ``table``, or under their own if they name one: both_ends, one_seat, walk, outcome, and the names of the ends.

    Two joins with the station table, broadcast as long as it is small: pairs
    are not shuffled then. Of routes only masks and the near columns are read.
    """
    small = if_small(table) is not table  # it grows with the stations and the product of the scenarios
    hint = F.broadcast if small else lambda df: df
    columns = ["station", "routes", "hit", "mask", *[f"near_{i}" for i in range(len(known))]]
    end = lambda p: hint(table.select("scenario", F.col("complex_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns]))
    own = ["scenario"] if "scenario" in pairs.columns else []
    joined = pairs.join(end("origin"), [*own, "origin_id"]).join(end("dest"), ["scenario", "dest_id"])
    one_seat = bitmaps.meet(F.col("origin_mask"), F.col("dest_mask"))

    def walk(at: str, other: str) -> list[Column]:
        near = lambda i: F.col(f"{at}_near_{i}")
        to = lambda i: F.struct(near(i)["dist_m"].alias("dist_m"), F.lit(at == "origin").alias("at_origin"), *[near(i)[c].alias(c) for c in ("route", "point", "platform", "to_complex")])
        return [F.when(near(i).isNotNull() & bitmaps.has(F.col(f"{other}_mask"), i), to(i)) for i in range(len(known))]

    # ties: the walk at the destination, then route, point and platform in order
    walks = [*walk("dest", "origin"), *walk("origin", "dest")]
    shortest = F.least(*walks) if walks else F.lit(None).cast("struct<dist_m:double,at_origin:boolean,route:string,point:int,platform:int,to_complex:int>")
    rows = joined.withColumns({"both_ends": F.col("origin_hit") & F.col("dest_hit"), "one_seat": one_seat, "walk": F.when(~one_seat, shortest), "evaluated": F.lit(True)})
    close = F.coalesce(F.col("walk.dist_m") <= close_m, F.lit(False))
    return rows.withColumns({"close": close, "outcome": outcome(F.col("one_seat"), close)}).select(*ROW, "origin_mask", "dest_mask")


def touched(table: DataFrame, baseline: str, known: list[str]) -> DataFrame:
    """scenario, complex_id, moved, moved_near: stations that a scenario changes, in name or routes, or (a mask) in the nearest platform of a route."""
    was = table.filter(F.col("scenario") == baseline).select("complex_id", F.struct("station", "mask", *[f"near_{i}" for i in range(len(known))]).alias("was"))
    pair = table.filter(F.col("scenario") != baseline).join(if_small(was), "complex_id")
    moved = (F.col("station") != F.col("was.station")) | (F.col("mask") != F.col("was.mask"))
    near = [F.when(~F.col(f"near_{i}").eqNullSafe(F.col(f"was.near_{i}")), bitmaps.bit(i)).otherwise(F.lit(0).cast("long")) for i in range(len(known))]
    return pair.select("scenario", "complex_id", moved.alias("moved"), reduce(lambda a, b: a.bitwiseOR(b), near, F.lit(0).cast("long")).alias("moved_near")).filter("moved OR moved_near <> 0")


def with_differences(base: DataFrame, table: DataFrame, changed: DataFrame, baseline: str, known: list[str], close_m: float = CLOSE_M) -> DataFrame:
    """The baseline's rows, and every other scenario's: pairs that it cannot change take the baseline's outcome, the others are evaluated.

    A scenario can change a pair if it changes the name or routes of an end, or
    the nearest platform, from one end, of a route of the other's. ``changed``
    is :func:`touched`; it and ``base`` are read several times: cache them.
    """
    others = table.filter(F.col("scenario") != baseline).select("scenario").distinct()
    hint = F.broadcast if if_small(changed) is not changed else lambda df: df
    end = lambda p: hint(changed.select("scenario", F.col("complex_id").alias(f"{p}_id"), F.col("moved").alias(f"{p}_moved"), F.col("moved_near").alias(f"{p}_near")))
    each = base.drop("scenario").crossJoin(F.broadcast(others))  # a handful of scenarios
    marked = each.join(end("origin"), ["scenario", "origin_id"], "left").join(end("dest"), ["scenario", "dest_id"], "left")
    reached = F.coalesce(bitmaps.meet(F.col("origin_near"), F.col("dest_mask")), F.lit(False)) | F.coalesce(bitmaps.meet(F.col("dest_near"), F.col("origin_mask")), F.lit(False))
    again = F.coalesce("origin_moved", F.lit(False)) | F.coalesce("dest_moved", F.lit(False)) | reached
    same = marked.filter(~again).withColumn("evaluated", F.lit(False)).select(*ROW)
    redone = evaluated(marked.filter(again).select("scenario", "origin_id", "dest_id", "ridership"), table, known, close_m)
    return base.select(*ROW).unionByName(same).unionByName(redone.select(*ROW))


def classified(pairs: DataFrame, ends: DataFrame, in_scope: DataFrame, close_m: float = CLOSE_M) -> DataFrame:
    """Every pair evaluated under every scenario."""
    known = bitmaps.dictionary(ends)
    return evaluated(pairs, station_table(ends, in_scope, known), known, close_m).select(*ROW)


def with_walk_station(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``walk_station``, the name under the scenario of the complex that the walk reaches."""
    names = ends.select("scenario", F.col("complex_id").alias("__to"), F.col("station").alias("walk_station"))
    return rows.withColumn("__to", F.col("walk.to_complex")).join(F.broadcast(names), ["scenario", "__to"], "left").drop("__to")


def _stats(n_days: int) -> list[Column]:
    r = F.col("ridership")
    part = lambda c: average(F.coalesce(F.sum(F.when(c, r)), F.lit(0)), n_days)
    return [
        average(F.coalesce(F.sum(r), F.lit(0)), n_days).alias("total"), part(F.col("one_seat")).alias("one_seat"), part(F.col("outcome") == "close").alias("close"),
        part(F.col("outcome") != "far").alias("effective"),
    ]


def rider_stats(rows: DataFrame, n_days: int) -> DataFrame:
    """total, one_seat, close, effective of each scenario."""
    return rows.groupBy("scenario").agg(*_stats(n_days))


def station_stats(rows: DataFrame, side: str, n_days: int) -> DataFrame:
    """The same of each station as ``origin`` or ``dest``, over pairs with both ends in scope."""
    return rows.filter("both_ends").groupBy("scenario", F.col(f"{side}_id").alias("complex_id"), F.col(f"{side}_station").alias("station")).agg(*_stats(n_days))


def symmetric(rows: DataFrame, n_days: int, keys: tuple[str, ...] = ("scenario",), carried: tuple[str, ...] = ("outcome",)) -> DataFrame:
    """Both directions of a pair as one row: the busier goes forward, of equals the one with the lower origin.

    ``carried`` columns are those of the forward direction.
    """
    pair = [F.least("origin_id", "dest_id").alias("low_id"), F.greatest("origin_id", "dest_id").alias("high_id")]
    both = rows.groupBy(*keys, *pair).agg(
        F.max(F.struct("ridership", (-F.col("origin_id")).alias("n"), "dest_id", *carried)).alias("f"), F.sum("ridership").alias("sum")
    )
    return both.select(
        *keys, (-F.col("f.n")).alias("origin_id"), F.col("f.dest_id").alias("dest_id"), average(F.col("f.ridership"), n_days).alias("forward"),
        average(F.col("sum") - F.col("f.ridership"), n_days).alias("reverse"), average(F.col("sum"), n_days).alias("riders"), *[F.col(f"f.{c}").alias(c) for c in carried], F.col("sum").alias("ridership"),
    )


def compared(rows: DataFrame, baseline: str) -> DataFrame:
    """Pairs with both ends in scope, before (the baseline) and after (each other scenario)."""
    both = rows.filter("both_ends")
    before = both.filter(F.col("scenario") == baseline).select("origin_id", "dest_id", F.col("outcome").alias("before"), F.col("origin_station").alias("o_was"), F.col("origin_routes").alias("o_had"), F.col("dest_station").alias("d_was"), F.col("dest_routes").alias("d_had"))
    after = both.filter(F.col("scenario") != baseline).withColumnRenamed("outcome", "after")
    return after.join(before, ["origin_id", "dest_id"])


def transition_matrix(moves: DataFrame, n_days: int) -> DataFrame:
    """scenario, before, after, pairs, riders."""
    return moves.groupBy("scenario", "before", "after").agg(F.count(F.lit(1)).alias("pairs"), average(F.sum("ridership"), n_days).alias("riders"))


def gained_lost(moves: DataFrame, n_days: int) -> DataFrame:
    """Riders who gain and who lose an effective one-seat ride, and the difference."""
    gain = F.when((F.col("before") == "far") & (F.col("after") != "far"), F.col("ridership"))
    loss = F.when((F.col("before") != "far") & (F.col("after") == "far"), F.col("ridership"))
    g, x = F.coalesce(F.sum(gain), F.lit(0)), F.coalesce(F.sum(loss), F.lit(0))
    return moves.groupBy("scenario").agg(average(g, n_days).alias("gained"), average(x, n_days).alias("lost"), average(g - x, n_days).alias("net"))


def changed_pairs(moves: DataFrame, n_days: int) -> DataFrame:
    """Pairs whose outcome moved, both directions as one row, with labels that say what changes at either end."""
    label = F.concat(
        changed_label(F.col("o_was"), F.col("o_had"), F.col("origin_station"), F.col("origin_routes")), F.lit(" ↔ "),
        changed_label(F.col("d_was"), F.col("d_had"), F.col("dest_station"), F.col("dest_routes")),
    )
    moved = moves.filter("before <> after").withColumn("label", label)
    return symmetric(moved, n_days, ("scenario", "before", "after"), ("label",))


def top_changes(changes: DataFrame, n: int = 25) -> DataFrame:
    """The largest by riders; equals by transition and ids."""
    order = [F.desc("riders"), "before", "after", "origin_id", "dest_id"]
    best = changes.withColumn("place", F.row_number().over(Window.partitionBy("scenario").orderBy(*order))).filter(F.col("place") <= n)
    return best.select("scenario", "place", "before", "after", "origin_id", "dest_id", "riders", "label")


def station_changes(changes: DataFrame, n_days: int) -> DataFrame:
    """What a scenario does at each station: every changed pair counts at both its ends, and once if they are the same."""
    ends = changes.select("scenario", "before", "after", "ridership", F.explode(F.array_distinct(F.array("origin_id", "dest_id"))).alias("complex_id"))
    r = F.col("ridership")
    net = F.sum(F.when((F.col("before") == "far"), r).when(F.col("after") == "far", -r).otherwise(F.lit(0)))
    out = ends.groupBy("scenario", "complex_id").agg(average(F.sum(r), n_days).alias("total"), average(net, n_days).alias("net"))
    return out.withColumn("magnitude", F.abs("net"))


def changed_stations(ends: DataFrame, baseline: str) -> DataFrame:
    """scenario, complex_id, name: the station as the baseline names it, with what the scenario does to it."""
    was = ends.filter(F.col("scenario") == baseline).select("complex_id", F.col("station").alias("was"), F.col("routes").alias("had"))
    label = changed_label(F.col("was"), F.col("had"), F.col("station"), F.col("routes"))
    return ends.filter(F.col("scenario") != baseline).join(F.broadcast(was), "complex_id").select("scenario", "complex_id", label.alias("name"))
