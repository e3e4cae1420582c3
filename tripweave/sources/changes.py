"""Scenarios as tables: changes wanted of stations by name, checked and placed by joins, and combined.

A table of wanted changes has the columns category, scenario, line, station,
route and sign (1 adds the route, -1 takes it away). Stations go by the name
on their signs and their line, as in scenario files. Nothing passes the driver
but the names of the categories.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def station_names(platforms: DataFrame) -> DataFrame:
    """station, line, complex_id: every name that changes may use, with each complex that it means."""
    return platforms.select(F.col("name").alias("station"), "line", "complex_id").distinct()


def meant(wanted: DataFrame, platforms: DataFrame) -> DataFrame:
    """``wanted`` with ``n_meant``, how many complexes station and line name, and ``complex_id``, the least of them."""
    named = station_names(platforms).groupBy("station", "line").agg(F.count(F.lit(1)).alias("n_meant"), F.min("complex_id").alias("complex_id"))
    return wanted.join(named, ["station", "line"], "left").withColumn("n_meant", F.coalesce("n_meant", F.lit(0)))


def placed_changes(wanted: DataFrame, platforms: DataFrame) -> DataFrame:
    """category, scenario, complex_id, line, route, sign of the changes whose station is one complex; each once."""
    return meant(wanted, platforms).filter("n_meant = 1").select("category", "scenario", "complex_id", "line", "route", "sign").distinct()


def disagreements(placed: DataFrame, by: str = "scenario") -> DataFrame:
    """``by``, complex_id, line, route of what a scenario (or combination) both adds and takes away at one place."""
    return placed.groupBy(by, "complex_id", "line", "route").agg(F.countDistinct("sign").alias("signs")).filter("signs > 1").drop("signs")


def faults(wanted: DataFrame, platforms: DataFrame) -> DataFrame:
    """scenario, line, station, route, fault of every change that can't be made: ``no station``, ``ambiguous``, ``not served`` or ``both``.

    ``both``: the scenario adds and takes away the route at one complex and
    line, whatever the names it uses. Only taking away asks for a route that
    is there.
    """
    known = meant(wanted, platforms)
    served = platforms.select("complex_id", "line", F.explode("routes").alias("route")).distinct().withColumn("is_served", F.lit(True))
    torn = disagreements(placed_changes(wanted, platforms)).withColumn("is_torn", F.lit(True))
    marked = known.join(served, ["complex_id", "line", "route"], "left").join(torn, ["scenario", "complex_id", "line", "route"], "left")
    one = F.col("n_meant") == 1
    found = F.array_compact(F.array(
        F.when(F.col("n_meant") == 0, "no station"), F.when(F.col("n_meant") > 1, "ambiguous"),
        F.when(one & (F.col("sign") < 0) & F.col("is_served").isNull(), "not served"), F.when(one & F.col("is_torn"), "both"),
    ))
    return marked.select("scenario", "line", "station", "route", F.explode(found).alias("fault")).distinct()


def combinations(options: DataFrame) -> DataFrame:
    """name, description, category and parts of every choice of one scenario, or none, of each category.

    ``options``: category, scenario, description. Categories, of which there
    are a handful, go in order of their names; no choice at all is ``Current``.
    """
    spark = options.sparkSession
    part = F.struct("scenario", "description", "category").alias("part")
    names = sorted(r[0] for r in options.select("category").distinct().collect())
    every = spark.range(1).select(F.array().cast("array<struct<scenario:string,description:string,category:string>>").alias("parts"))
    for name in names:
        choice = options.filter(F.col("category") == name).select(part).distinct()
        # as many rows as there are combinations: the product is what is asked for
        every = every.unionAll(every.crossJoin(choice).select(F.concat("parts", F.array("part")).alias("parts")))
    said = lambda field, none: F.when(F.size("parts") == 0, none).otherwise(F.array_join(F.transform("parts", lambda p: p[field]), " + "))
    return every.select(
        said("scenario", "Current").alias("name"), said("description", "today's routes").alias("description"), said("category", "Current").alias("category"),
        F.transform("parts", lambda p: p["scenario"]).alias("parts"),
    )


def combined_moves(placed: DataFrame, combined: DataFrame) -> DataFrame:
    """scenario (the combination's name), complex_id, line, add, remove: what all parts of each combination change, a row a place."""
    each = combined.select(F.col("name").alias("combination"), F.explode("parts").alias("scenario")).join(placed, "scenario")
    of = lambda sign: F.array_sort(F.collect_set(F.when(F.col("sign") == sign, F.col("route"))))
    return each.groupBy(F.col("combination").alias("scenario"), "complex_id", "line").agg(of(1).alias("add"), of(-1).alias("remove"))


def exchanged(platforms: DataFrame, category: str, scenario: str, line: str, lost: str, won: str) -> DataFrame:
    """Wanted changes: on a line ``won`` takes the place of ``lost`` wherever it runs and the station's name means one complex."""
    at = platforms.filter((F.col("line") == line) & F.array_contains("routes", lost)).select(F.col("name").alias("station"), "line").distinct()
    alone = station_names(platforms).groupBy("station", "line").count().filter("count = 1").select("station", "line")
    signs = F.explode(F.array(F.struct(F.lit(won).alias("route"), F.lit(1).alias("sign")), F.struct(F.lit(lost).alias("route"), F.lit(-1).alias("sign")))).alias("s")
    return at.join(alone, ["station", "line"]).select(F.lit(category).alias("category"), F.lit(scenario).alias("scenario"), "line", "station", signs).select("category", "scenario", "line", "station", "s.route", "s.sign")


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
