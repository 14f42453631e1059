"""Circular statistics of angles in radians, and the timing of floods within the year. Missing is null and never counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_year, year
from .series import peaks

PI = math.pi


def components(a: Column, p: int = 1, phi: float = 0.0, weight: Column | None = None) -> tuple[Column, Column]:
    """Weighted mean cosine and sine of p times the angle from phi."""
    wt = weight if weight is not None else F.when(a.isNotNull(), 1.0)
    total = F.sum(F.when(a.isNotNull(), wt))
    return F.try_divide(F.sum(wt * F.cos(p * (a - phi))), total), F.try_divide(F.sum(wt * F.sin(p * (a - phi))), total)


def mean(a: Column, p: int = 1, phi: float = 0.0, weight: Column | None = None) -> Column:
    c, s = components(a, p, phi, weight)
    return F.atan2(s, c)


def length(a: Column, p: int = 1, phi: float = 0.0, weight: Column | None = None) -> Column:
    c, s = components(a, p, phi, weight)
    return F.sqrt(c * c + s * s)


def variance(a: Column) -> Column:
    return 1 - length(a)


def rayleigh(a: Column) -> Column:
    """p of uniformity; the second-order term only for fewer than 50 angles."""
    n, r = F.count(a).cast("double"), length(a)
    terms = lambda v: F.exp(-v["z"]) * F.when(v["n"] < 50, 1 + v["z"] * (2 - v["z"]) / (4 * v["n"]) - v["z"] * (24 - v["z"] * (132 - v["z"] * (76 - 9 * v["z"]))) / (288 * v["n"] * v["n"])).otherwise(1.0)
    return F.when(n > 0, F.transform(F.array(F.struct(n.alias("n"), (n * r * r).alias("z"))), terms)[0])


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, r) over pairs: sines of the distances from the circular means."""
    w = Window.partitionBy(*keys)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    off = lambda c: F.sin(F.col(c) - F.atan2(F.sum(F.sin(c)).over(w), F.sum(F.cos(c)).over(w)))
    d = pairs.select(*keys, off(a).alias("_a"), off(b).alias("_b"))
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))).alias("r"))


def angle_diff(a: Column, b: Column) -> Column:
    """b - a; a difference of pi or more is 2 pi less its size, so its sign is lost."""
    d = b - a
    return F.when(F.abs(d) >= PI, 2 * PI - F.abs(d)).otherwise(d)


def angle_diff_signed(a: Column, b: Column) -> Column:
    """b - a within [-pi, pi)."""
    return F.pmod(b - a + PI, F.lit(2 * PI)) - PI


def doy_to_angle(doy: Column, in_year: Column) -> Column:
    a = doy * 2 * PI / days_in_year(F.make_date(in_year.cast("int"), F.lit(1), F.lit(1)))
    return F.when(a > PI, a - 2 * PI).otherwise(a)


def angle_to_doy(a: Column, days: float = 365.0) -> Column:
    d = F.when(a < 0, a + 2 * PI).otherwise(a) * days / (2 * PI)
    return F.when(d < 1, F.lit(float(days))).otherwise(d)


def flood_days(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", min_dist: int = 1) -> DataFrame:
    """(keys, year, annual_max, doy): the greatest peak of each year and its first day; null without a peak."""
    p = peaks(df, keys, t, x, min_dist)
    first = F.max_by(F.dayofyear(t).cast("long"), F.when(F.col("peak").isNotNull(), F.struct(F.col("peak"), -F.dayofyear(t))))
    return p.groupBy(*keys, year(F.col(t)).alias("year")).agg(F.max("peak").alias("annual_max"), first.alias("doy")).withColumn("doy", F.when(F.col("annual_max").isNotNull(), F.col("doy")))


def mean_flood_day(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doy_mean, doy_var, doy_uniform_p) of flood_days()."""
    a = F.col("_angle")
    angles = days.select(*keys, doy_to_angle(F.col("doy"), F.col("year")).alias("_angle"))
    m = angles.groupBy(*keys).agg(mean(a).alias("_mean"), variance(a).alias("doy_var"), rayleigh(a).alias("doy_uniform_p"))
    return m.select(*keys, angle_to_doy(F.col("_mean")).alias("doy_mean"), "doy_var", "doy_uniform_p")


def flood_day_stats(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", min_dist: int = 1) -> DataFrame:
    """(keys, annual_max, doy, doy_mean, doy_var, doy_uniform_p): per-year values beside the series' statistics."""
    days = flood_days(df, keys, t, x, min_dist)
    return days.join(mean_flood_day(days, keys), keys)
