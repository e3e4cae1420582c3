"""Flows between a region and the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_boroughs, in_box, in_cbd
from ..functions.names import flow_label
from .pairs import average

#: Borough codes and their names.
BOROUGHS = {"M": "Manhattan", "Bk": "Brooklyn", "Bx": "The Bronx", "Q": "Queens", "SI": "Staten Island"}
PRESETS = ("cbd", "manhattan", "brooklyn", "bronx", "queens", "staten-island")


class RegionError(ValueError):
    """A region that cannot be understood or has no station."""


Region = tuple[str, Callable[[], Column]]


def parsed_box(text: str) -> tuple[float, float, float, float]:
    """``min_lat,min_lon,max_lat,max_lon``."""
    try:
        box = tuple(float(x) for x in text.split(","))
    except ValueError as e:
        raise RegionError(f"not a bounding box: {text!r}") from e
    if len(box) != 4 or box[0] > box[2] or box[1] > box[3]:
        raise RegionError(f"not a bounding box: {text!r}")
    return box  # type: ignore[return-value]


def resolved_region(preset: str = "cbd", boroughs: str | None = None, box: str | None = None, label: str | None = None) -> Region:
    """One of a preset, a list of boroughs and a bounding box, with a label and a predicate over station columns."""
    if boroughs and box:
        raise RegionError("give boroughs or a bounding box, not both")
    if box:
        corners = parsed_box(box)
        return label or f"bbox {box}", lambda: in_box(*corners)
    if boroughs:
        codes = [b.strip() for b in boroughs.split(",") if b.strip()]
        unknown = [c for c in codes if c not in BOROUGHS]
        if unknown or not codes:
            raise RegionError(f"unknown boroughs {unknown}; known are {list(BOROUGHS)}")
        return label or "+".join(BOROUGHS[c] for c in codes), lambda: in_boroughs(codes)
    if preset == "cbd":
        return label or "the CBD", in_cbd
    code = {"manhattan": "M", "brooklyn": "Bk", "bronx": "Bx", "queens": "Q", "staten-island": "SI"}.get(preset)
    if code is None:
        raise RegionError(f"unknown region {preset!r}; known are {list(PRESETS)}")
    return label or BOROUGHS[code], lambda: in_boroughs([code])


def check_region(complexes: DataFrame, region: Column) -> int:
    n = complexes.filter(region).count()
    if not n:
        raise RegionError("no station lies in the region")
    return n


def classified(pairs: DataFrame, complexes: DataFrame, region: Column) -> DataFrame:
    """Pairs with the names of their ends and whether each lies in the region."""
    ends = complexes.select("complex_id", "name", region.alias("inside"))
    o = F.broadcast(ends.select(F.col("complex_id").alias("origin_id"), F.col("name").alias("origin_name"), F.col("inside").alias("origin_in")))
    d = F.broadcast(ends.select(F.col("complex_id").alias("dest_id"), F.col("name").alias("dest_name"), F.col("inside").alias("dest_in")))
    return pairs.join(o, "origin_id", "left").join(d, "dest_id", "left")


def quadrants(flows: DataFrame, n_days: int) -> DataFrame:
    """Riders by where they start and end, with totals between and within region and rest: one row."""
    o, d, r = F.col("origin_in"), F.col("dest_in"), F.col("ridership")
    total = lambda c: average(F.coalesce(F.sum(F.when(c, r)), F.lit(0)), n_days)
    return flows.agg(
        average(F.coalesce(F.sum(r), F.lit(0)), n_days).alias("total"), total(o & d).alias("in_in"), total(o & ~d).alias("in_out"),
        total(~o & d).alias("out_in"), total(~o & ~d).alias("out_out"), total(o != d).alias("inter"), total(o == d).alias("intra"),
    )


def top_pairs(flows: DataFrame, n_days: int, n: int = 25) -> DataFrame:
    """The busiest pairs; equals in the order of their ids."""
    best = flows.withColumn("riders", average(F.col("ridership"), n_days)).orderBy(F.desc("riders"), "origin_id", "dest_id").limit(n)
    return best.select("origin_id", "origin_name", "dest_id", "dest_name", "riders", "origin_in", "dest_in", flow_label(F.col("origin_in"), F.col("dest_in")).alias("flow"))
