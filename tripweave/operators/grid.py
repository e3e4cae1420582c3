"""Nearest goals by a grid: an equi-join on cells instead of a comparison of everything with everything.

The globe is cut into cells on several levels, each with cells twice as wide
as the one before. One goal stands for each cell; the nearest of those of the
cells around a place, one a level, bounds the distance of its nearest goal. On
the first level whose cells are wider than this distance the three by three
cells around the place hold every goal that can be as near, so that ring, and
no further one, decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m

#: Columns of cells around the globe on level 0 are 2**FINEST: cells of 43 m in height.
FINEST = 20
#: Rows, at most, of a table of stations that is broadcast.
BROADCAST_ROWS = 100_000


def _columns(level: Column) -> Column:
    """Columns of cells around the globe on a level."""
    return F.pow(F.lit(2.0), F.lit(FINEST) - level)


def cell(lat: Column, lon: Column, level: Column) -> tuple[Column, Column]:
    """Row and column of the cell of a place."""
    n = _columns(level)
    across = F.pmod(F.floor((lon + 180) / 360 * n), n.cast("long"))
    return F.floor((lat + 90) / 360 * n), across


def neighbours(lat: Column, lon: Column, level: Column) -> Column:
    """The cell of a place and the eight around it; columns go round the globe."""
    row, column = cell(lat, lon, level)
    n = _columns(level).cast("long")
    return F.array_distinct(F.array(*[F.struct((row + i).alias("cell_row"), F.pmod(column + j, n).alias("cell_column")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def clear_m(lat: Column, level: int) -> Column:
    """No place outside the nine cells around one at ``lat`` is nearer than this: the distance to a meridian one cell away."""
    width = 2 * math.pi / 2 ** (FINEST - level)
    if level >= FINEST - 1:
        return F.lit(float("inf"))  # two columns or one: the nine cells are all
    return EARTH_RADIUS_M * F.asin(F.cos(F.radians(lat)) * math.sin(min(width, math.pi / 2)))


def finest_level(n: int, groups: int, side: float) -> int:
    """The level whose cells hold about two goals of a group, of ``n`` in all, over an area as large as a square of ``side`` degrees."""
    width = side * math.sqrt(2 * max(1, groups) / max(1, n))
    return min(FINEST, max(0, FINEST - round(math.log2(360 / width))))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows; else Spark may choose another join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nearest_goals(asked: DataFrame, goals: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``asked`` with the columns of ``group``, ``best``, the least struct (dist_m, *order) over all goals of its group, and ``compared``, how many distances that took.

    ``asked`` has lat, lon, and others that tell rows apart, ``goals`` has the
    columns of ``group``, to_lat and to_lon. A place is asked about every group
    that agrees with the columns of ``group`` that it has itself; a group
    without goals gives no row. ``order`` names columns of either. Goals are
    dealt out by cell, so one group may hold all of them.
    """
    own = [c for c in group if c in asked.columns]
    n, groups, south, north, west, east = goals.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*group)), F.min("to_lat"), F.max("to_lat"), F.min("to_lon"), F.max("to_lon")).first()
    side = math.sqrt(max(north - south, 1e-3) * max(east - west, 1e-3)) if n else 1.0
    levels = list(range(finest_level(n, groups, side), FINEST + 1))
    hint = F.broadcast if n * len(levels) <= BROADCAST_ROWS else lambda df: df  # of goals and their groups
    every = F.explode(F.array(*[F.lit(x) for x in levels])).alias("cell_level")
    level, here = F.col("cell_level"), [*group, "cell_level", "cell_row", "cell_column"]
    in_cell = lambda df, lat, lon: df.withColumns(dict(zip(("cell_row", "cell_column"), cell(F.col(lat), F.col(lon), level))))
    placed = in_cell(goals.select("*", every), "to_lat", "to_lon")
    standing = placed.groupBy(*here).agg(F.min(F.struct("to_lat", "to_lon")).alias("one"))
    names = hint(goals.select(*group).distinct())
    wanted = asked.join(names, own) if own else asked.crossJoin(names)
    keys = wanted.columns
    apart = lambda lat, lon: haversine_m(F.col("lat"), F.col("lon"), lat, lon)
    bounds = F.min(apart(F.col("one.to_lat"), F.col("one.to_lon"))) * (1 + 1e-9) + 1e-6
    bound = in_cell(wanted.select("*", every), "lat", "lon").join(hint(standing), here).groupBy(*keys).agg(bounds.alias("__bound"), F.count(F.lit(1)).alias("__seen"))
    wide = F.coalesce(*[F.when(clear_m(F.col("lat"), x) > F.col("__bound"), F.lit(x)) for x in levels], F.lit(FINEST))
    around = bound.withColumn("cell_level", wide).withColumn("__cell", F.explode(neighbours(F.col("lat"), F.col("lon"), level))).select("*", "__cell.*")
    best = F.min(F.struct(apart(F.col("to_lat"), F.col("to_lon")).alias("dist_m"), *order)).alias("best")
    found = around.join(hint(placed), here).groupBy(*keys, "__seen").agg(best, F.count(F.lit(1)).alias("__more"))
    return found.select(*keys, "best", (F.col("__seen") + F.col("__more")).alias("compared"))
