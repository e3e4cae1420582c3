"""Algebra of route sets: sorted arrays without repeats or nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def route_set(text: Column) -> Column:
    """The routes of a blank-separated list; an empty or null list has none."""
    parts = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda r: r != "")
    return F.array_sort(F.array_distinct(parts))


def literal_set(routes) -> Column:
    """A constant route set."""
    return F.array(*[F.lit(r) for r in sorted(routes)]).cast("array<string>")


def any_of(a: Column, b: Column) -> Column:
    """Whether two sets share a route: never null."""
    return F.size(F.array_intersect(a, b)) > 0


def common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(*sets: Column) -> Column:
    return F.array_sort(reduce(F.array_union, sets))


def with_delta(routes: Column, add: Column, remove: Column) -> Column:
    """Takes away first and adds then, so a route in both stays."""
    return union(F.array_except(routes, remove), add)


def prefer(routes: Column, primary: Column) -> Column:
    """The primary ones among the routes if there are any, else all."""
    found = common(routes, primary)
    return F.when(F.size(found) > 0, found).otherwise(routes)


def assigned_routes(routes: Column, primary: Column, corridor_a: Column, corridor_b: Column, to_a: Column, to_b: Column) -> Column:
    """An origin's routes when its corridors are served by other primary routes.

    Routes that are not primary stay; a station on neither corridor keeps what it has.
    """
    on_a, on_b = any_of(routes, corridor_a), any_of(routes, corridor_b)
    kept = F.array_except(routes, primary)

    def given(assigned: Column) -> Column:
        return union(kept, F.array_intersect(assigned, primary))

    return F.when(on_a & on_b, given(F.array_union(to_a, to_b))).when(on_a, given(to_a)).when(on_b, given(to_b)).otherwise(routes)
