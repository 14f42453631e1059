"""Resampling, climatologies, anomalies, and time joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import season, year

REDUCE = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count}


def resample(df: DataFrame, keys: list[str], unit: str, how: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """(keys, t, x_<how>): one row for each unit of time that has rows."""
    return df.groupBy(*keys, F.date_trunc(unit, t).alias(t)).agg(*[REDUCE[h](x).alias(f"{x}_{h}") for h in how])


def annual_then_mean(df: DataFrame, keys: list[str], how: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Reduces each year, then averages over the years."""
    y = df.groupBy(*keys, year(F.col(t)).alias("_y")).agg(*[REDUCE[h](x).alias(f"{x}_a{h}") for h in how])
    return y.groupBy(*keys).agg(*[F.avg(f"{x}_a{h}").alias(f"{x}_a{h}") for h in how])


def monthly(df: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    return df.groupBy(*keys, F.month(t).cast("long").alias("month")).agg(F.avg(x).alias("clim"))


def seasonal(df: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    return df.groupBy(*keys, season(F.col(t)).alias("season")).agg(F.avg(x).alias("mean"))


def anomalies(df: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Adds clim (the month's mean) and anomaly; anomaly + clim gives the value back. A window, so the series isn't joined."""
    clim = F.avg(x).over(Window.partitionBy(*keys, F.month(t)))
    return df.withColumn("clim", clim).withColumn("anomaly", F.col(x) - F.col("clim"))


def both(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Rows of anchors that have a value (_g 0, _here their time and value) and of grid (_g 1, _here null)."""
    here = anchors.where(F.col(x).isNotNull()).select(*keys, t, F.lit(0).alias("_g"), F.struct(F.col(t).alias("t"), F.col(x).cast("double").alias("x")).alias("_here"))
    return here.unionByName(grid.select(*keys, t, F.lit(1).alias("_g"), F.lit(None).cast(here.schema["_here"].dataType).alias("_here")))


def sided(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """The grid's rows of `both`, with _a and _b, the anchors before and after, as _t0, _x0, _t1, _x1."""
    return df.where("_g = 1").select(*keys, t, F.col("_a.t").alias("_t0"), F.col("_a.x").alias("_x0"), F.col("_b.t").alias("_t1"), F.col("_b.x").alias("_x1"))


def to_grid(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """grid (keys, t) with the row before and after of anchors (keys, t, x): _t0, _x0, _t1, _x1. One shuffle and two sorts by time,
    no range join; frames run from the start only, as others are filled anew for each row."""
    w = Window.partitionBy(*keys)
    back, ahead = (w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((t, "_g"), (F.desc(t), F.desc("_g"))))
    return sided(both(anchors, grid, keys, t, x).withColumns({"_a": F.last("_here", True).over(back), "_b": F.last("_here", True).over(ahead)}), keys, t)


def interpolate_time(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x", sides: Callable[..., DataFrame] = to_grid) -> DataFrame:
    """Linear in time between anchors; null outside. An anchor at a grid time gives its own value. With `ordered.to_grid` as sides a
    series may be of any length."""
    g = sides(anchors, grid, keys, t, x)
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    share = (s(t) - s("_t0")) / (s("_t1") - s("_t0"))
    return g.select(*keys, t, F.when(F.col("_t0") == F.col(t), F.col("_x0")).otherwise(F.col("_x0") + share * (F.col("_x1") - F.col("_x0"))).alias(x))


def nearest_time(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x", sides: Callable[..., DataFrame] = to_grid) -> DataFrame:
    """The value of the nearest anchor in time; of two as near, the earlier. Anchors of one time should be one row. `sides` as in
    interpolate_time."""
    g = sides(anchors, grid, keys, t, x)
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    earlier = F.col("_t1").isNull() | (s(t) - s("_t0") <= s("_t1") - s(t))
    return g.select(*keys, t, F.when(F.col("_t0").isNotNull() & earlier, F.col("_x0")).otherwise(F.col("_x1")).alias(x))


def nearest_time_union(anchors: DataFrame, instants: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """nearest_time for a grid that all series share: instants (t). The result has a row for every series and instant; whether the
    smaller side is broadcast is left to Spark, by its size."""
    return nearest_time(anchors, anchors.select(*keys).distinct().crossJoin(instants), keys, t, x)


def expected_annual(df: DataFrame, keys: list[str], period: str = "T", x: str = "x") -> DataFrame:
    """(keys, expected): trapezoids over the exceedance probability 1 / T, with an added point of T = 1 and value 0."""
    pts = df.select(*keys, (1 / F.col(period)).alias("_p"), F.col(x).alias("_x"))
    pts = pts.unionByName(df.select(*keys).distinct().select(*keys, F.lit(1.0).alias("_p"), F.lit(0.0).alias("_x")))
    w = Window.partitionBy(*keys).orderBy("_p")
    area = (F.lead("_p").over(w) - F.col("_p")) * (F.lead("_x").over(w) + F.col("_x")) / 2
    return pts.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("expected"))
