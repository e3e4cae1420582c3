"""Route sets as 64-bit masks: a dictionary gives every route a bit, and sets meet if their masks do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Routes that a mask has room for; the sign bit stays free.
ROOM = 63


def dictionary(sets: DataFrame, column: str = "routes") -> list[str]:
    """The routes of all sets in order; a route's place is its bit."""
    found = sorted(r[0] for r in sets.select(F.explode(column)).distinct().limit(ROOM + 1).collect())
    if len(found) > ROOM:
        raise ValueError(f"there are more than {ROOM} routes")
    return found


def bit(place: int) -> Column:
    return F.lit(1 << place).cast("long")


def mask(routes: Column, known: list[str]) -> Column:
    """The set as a mask; routes that the dictionary lacks have no bit."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.array_contains(routes, r), bit(i)).otherwise(F.lit(0).cast("long")) for i, r in enumerate(known)), F.lit(0).cast("long"))


def meet(a: Column, b: Column) -> Column:
    """Whether two masks have a route in common."""
    return a.bitwiseAND(b) != 0


def has(a: Column, place: int) -> Column:
    return meet(a, bit(place))


def routes_of(a: Column, known: list[str]) -> Column:
    """The mask's routes as a sorted array."""
    return F.array_compact(F.array(*[F.when(has(a, i), F.lit(r)) for i, r in enumerate(known)])).cast("array<string>")
