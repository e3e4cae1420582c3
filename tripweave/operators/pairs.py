"""From trips to station pairs: day filter, coverage, the pair aggregate, and checks of its ends."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.settled import settled

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
DAY_TYPES: dict[str, tuple[str, ...] | None] = {"weekday": WEEKDAYS, "saturday": ("Saturday",), "sunday": ("Sunday",), "all": None}


class DayFilterError(ValueError):
    """No day of the table matches the filter."""


class UnknownStationError(ValueError):
    """A pair names a station that the reference table lacks."""


class DayCoverage(NamedTuple):
    """Distinct groups of year, month and day of the week, and the first and last month."""

    n_days: int
    first_month: int
    last_month: int

    def label(self) -> str:
        return " to ".join(f"{m // 100}-{m % 100:02d}" for m in (self.first_month, self.last_month))


def chosen_days(day_type: str = "weekday", days: str | None = None) -> tuple[str, ...] | None:
    """The days of a preset, or an explicit list: trimmed, case-sensitive, empty names kept. None: no filter."""
    return tuple(d.strip() for d in days.split(",")) if days is not None else DAY_TYPES[day_type]


def day_filter(days: tuple[str, ...] | None) -> Column:
    return F.lit(True) if not days else F.col("day_of_week").isin(*days)


def coverage_table(trips: DataFrame, days: tuple[str, ...] | None) -> DataFrame:
    """n_days, first_month, last_month over the whole table under the day filter, whatever the scope."""
    month = (F.col("year") * 100 + F.col("month")).alias("m")
    return trips.filter(day_filter(days)).select(month, "day_of_week").distinct().agg(F.count(F.lit(1)).alias("n_days"), F.min("m").alias("first_month"), F.max("m").alias("last_month"))


def coverage(trips: DataFrame, days: tuple[str, ...] | None) -> DayCoverage:
    found = coverage_table(trips, days).first()
    if not found["n_days"]:
        raise DayFilterError(f"no day matches the filter {list(days or ())}")
    return DayCoverage(*found)


def pair_sums(trips: DataFrame, days: tuple[str, ...] | None, scope: Column | None = None) -> DataFrame:
    """origin_id, dest_id, ridership: exact sums; filters reach the scan, sums are partial before the shuffle."""
    kept = trips.filter(day_filter(days))
    kept = kept if scope is None else kept.filter(scope)
    return kept.groupBy("origin_id", "dest_id").agg(F.sum("ridership").alias("ridership"))


def counted_pairs(trips: DataFrame, days: tuple[str, ...] | None, name: str = "pairs") -> tuple[DataFrame, DayCoverage]:
    """:func:`pair_sums` of all stations, written out, and the coverage, which the same scan observes: a group of year, month and day is one number, of which there are few."""
    seen, month = Observation(), F.col("year") * 100 + F.col("month")
    observed = trips.filter(day_filter(days)).observe(seen, F.collect_set(F.concat_ws(" ", month, "day_of_week")).alias("groups"), F.min(month).alias("first"), F.max(month).alias("last"))
    sums = settled(pair_sums(observed, None), name)
    if sums.isEmpty():  # nothing is observed of a plan that turns out empty
        raise DayFilterError(f"no day matches the filter {list(days or ())}")
    found = seen.get
    return sums, DayCoverage(len(found["groups"]), found["first"], found["last"])


def origin_in(ids: list[int]) -> Column:
    return F.col("origin_id").isin(*ids) if ids else F.lit(False)


def either_end_in(ids: list[int]) -> Column:
    return (F.col("origin_id").isin(*ids) | F.col("dest_id").isin(*ids)) if ids else F.lit(False)


def average(total: Column, n_days: int) -> Column:
    """Riders of an average day from an exact sum, divided once."""
    return F.round(total.cast("double") / n_days, 6)


def check_ends(pairs: DataFrame, complexes: DataFrame) -> None:
    """Every end has to be in the reference table: a pair is never dropped for want of it."""
    ends = pairs.select(F.explode(F.array("origin_id", "dest_id")).alias("complex_id")).distinct()
    lost = [r[0] for r in ends.join(F.broadcast(complexes.select("complex_id")), "complex_id", "left_anti").limit(5).collect()]
    if lost:
        raise UnknownStationError(f"station complexes {sorted(lost)} are not in the station table")
