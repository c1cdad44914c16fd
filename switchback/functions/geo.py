"""Distances, tiles and terrain pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The engine's Earth, and the plain scale of ride matching.
EARTH_M = 6371008.8
RIDE_DEG_M = 111320.0
ZOOM = 12


def planar_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column, deg_m: float | None = None) -> Column:
    """Planar distance with the cosine of the first point's latitude."""
    scale = F.radians(F.lit(1.0)) * EARTH_M if deg_m is None else F.lit(deg_m)
    return F.hypot((lon1 - lon0) * F.cos(F.radians(lat0)), lat1 - lat0) * scale


def haversine_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def bearing_deg(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    d = F.radians(lon1 - lon0)
    y = F.sin(d) * F.cos(F.radians(lat1))
    x = F.cos(F.radians(lat0)) * F.sin(F.radians(lat1)) - F.sin(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def lon_pad(lat: Column, metres: float = 35.0) -> Column:
    """Degrees of longitude that span so many metres at a latitude."""
    return metres / (RIDE_DEG_M * F.cos(F.radians(lat)))


def offset(lon: Column, lat: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(lon, lat) of a point dx metres east and dy metres north."""
    return lon + F.degrees(dx / (EARTH_M * F.cos(F.radians(lat)))), lat + F.degrees(dy / EARTH_M)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def pixel_x(lon: Column) -> Column:
    return (lon + 180) / 360 * (2**ZOOM * 256) - 0.5


def pixel_y(lat: Column) -> Column:
    r = F.radians(lat)
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * (2**ZOOM * 256) - 0.5


def terrarium_m(red: Column, green: Column, blue: Column) -> Column:
    """Metres as 32-bit floats, as the pixel code has them."""
    return (red * 256 + green + blue / 256 - 32768).cast("float")


def bilinear(z00: Column, z01: Column, z10: Column, z11: Column, fx: Column, fy: Column) -> Column:
    return z00 * (1 - fx) * (1 - fy) + z01 * fx * (1 - fy) + z10 * (1 - fx) * fy + z11 * fx * fy
