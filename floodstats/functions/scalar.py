"""Scalar expressions: guards, masks, sentinels, spheres and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clean(df: DataFrame, columns: list[str], sentinels: tuple[float, ...] = ()) -> DataFrame:
    """NaN, infinities and sentinels become null; every operator takes null as missing."""
    return df.withColumns({c: F.when(finite(F.col(c)) & ~F.col(c).isin(list(sentinels)) if sentinels else finite(F.col(c)), F.col(c)) for c in columns})


def log10_floor(x: Column, eps: float) -> Column:
    return F.log10(F.greatest(x, F.lit(eps)))


def log10_or_zero(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(0.0)


def percent(a: Column, b: Column, most: float = 100.0) -> Column:
    return F.least(a / F.greatest(b, F.lit(1.0)) * 100, F.lit(most))


def non_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def normalize_midpoint(x: Column, low: float, middle: float, high: float) -> Column:
    """Piecewise linear onto 0, 0.5 and 1."""
    return F.when(x < middle, (x - low) / (2 * (middle - low))).otherwise(0.5 + (x - middle) / (2 * (high - middle)))


def sphere_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6373000.0) -> Column:
    """Law of cosines in metres; the cosine is clamped, so that coincident points give 0."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1) - F.radians(lon2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * radius


def gauge_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6378137.0) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.cos(b - a) - F.cos(a) * F.cos(b) * (1 - F.cos(F.radians(lon2) - F.radians(lon1)))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * radius


def cell_area(lat: Column, dx: float, dy: float, radius: float = 6371000.0) -> Column:
    """Square metres of the cell centred at lat, dx by dy degrees."""
    low, high = F.radians(lat - abs(dy) / 2), F.radians(lat + abs(dy) / 2)
    return F.lit(radius**2 * math.radians(abs(dx))) * (F.sin(high) - F.sin(low))


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number, with the exceptions of Norway and Svalbard."""
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0)
    plain = F.floor((lon + 180) / 6).cast("int") + 1
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
    for west, east, number in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone = zone.when(svalbard & (lon >= west) & (lon < east), number)
    return zone.otherwise(F.when(plain > 60, 60).otherwise(plain))


def cell_index(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point; (x0, y0): the outer corner of cell (0, 0)."""
    return F.floor((y - y0) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def cell_centre(row: Column, col: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    return F.lit(x0) + (col + 0.5) * dx, F.lit(y0) + (row + 0.5) * dy


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres on the WGS84 ellipsoid by Krüger's series; southern northings count from ten million."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * east, 0.9996 * radius * north + F.when(lat < 0, 10_000_000).otherwise(0)


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lon, lat) of coordinates in a zone, the inverse of `utm`; south: whether northings count from ten million."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    e = 2 * math.sqrt(n) / (1 + n)
    xi = (north - F.when(south, 10_000_000).otherwise(0)) / (0.9996 * radius)
    eta = (east - 500_000) / (0.9996 * radius)
    x, y = xi, eta
    for j, c in enumerate(beta, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    d = F.atan2(F.sinh(y), F.cos(x))
    t = F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))  # tangent of the conformal latitude
    s = t / F.sqrt(1 + t * t)
    for _ in range(5):  # each step leaves some e^2 of the error
        s = F.tanh(F.asinh(t) + e * F.atanh(e * s))
    return zone * 6 - 183 + F.degrees(d), F.degrees(F.asin(s))
