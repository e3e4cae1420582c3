"""Distances and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS_M)


def in_cbd(prefix: str = "") -> Column:
    return F.col(f"{prefix}cbd")


def in_boroughs(codes: list[str], prefix: str = "") -> Column:
    return F.col(f"{prefix}borough").isin(codes)


def in_box(min_lat: float, min_lon: float, max_lat: float, max_lon: float, prefix: str = "") -> Column:
    """Borders count as inside."""
    return F.col(f"{prefix}lat").between(min_lat, max_lat) & F.col(f"{prefix}lon").between(min_lon, max_lon)
