"""Peaks, annual maxima, completeness and drivers of series in long form: keys, a time, a value.

A series is the rows of one combination of keys, ordered by the time column. All windows and aggregates of a function
are partitioned by the keys, so a chain of them shuffles once. Missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_year, year


def along(keys: list[str], t: str):
    return Window.partitionBy(*keys).orderBy(t)


def rising(x: Column, keys: list[str], t: str) -> Column:
    """Sign of the step from the row before; no change counts as falling."""
    step = F.signum(x - F.lag(x).over(along(keys, t)))
    return F.when(step == 0, -1.0).otherwise(step)


def peaks(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", min_dist: int = 1, out: str = "peak") -> DataFrame:
    """A peak is greater than the row before and not less than the one after: of a flat top the first row, and also the
    first row of a shelf in a rise. With min_dist d, it must equal the greatest peak in rows -d to d - 1; ties both stay."""
    w = along(keys, t)
    v = F.col(x)
    df = df.withColumn(out, F.when((v > F.lag(v).over(w)) & (F.lead(v).over(w) <= v), v))
    if min_dist > 1:
        df = df.withColumn(out, F.when(F.max(out).over(w.rowsBetween(-min_dist, min_dist - 1)) == F.col(out), F.col(out)))
    return df


def peaks_over_threshold(df: DataFrame, keys: list[str], threshold: float, t: str = "t", x: str = "x", min_dist: int = 1) -> DataFrame:
    """Only the rows of peaks greater than the threshold."""
    return peaks(df, keys, t, x, min_dist).where(F.col("peak") > threshold)


def annual_max(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", min_dist: int = 1) -> DataFrame:
    """(keys, year, am): the greatest peak of each year, null in a year without one."""
    return peaks(df, keys, t, x, min_dist).groupBy(*keys, year(F.col(t)).alias("year")).agg(F.max("peak").alias("am"))


def annual_max_mask(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", min_dist: int = 1) -> DataFrame:
    """All rows, with am where the row is its year's greatest peak; ties all stay."""
    df = peaks(df, keys, t, x, min_dist)
    most = F.max("peak").over(Window.partitionBy(*keys, year(F.col(t))))
    return df.withColumn("am", F.when(F.col("peak") == most, F.col("peak")))


def rolling_max(df: DataFrame, keys: list[str], half: int, t: str = "t", x: str = "x", out: str = "rolled") -> DataFrame:
    return df.withColumn(out, F.max(x).over(along(keys, t).rowsBetween(-half, half)))


def drivers(df: DataFrame, keys: list[str], level: str, others: list[str], t: str = "t", min_dist: int = 30, half: int = 5) -> DataFrame:
    """(keys, year, day, level, others): on each year's maximum of level, the day and the greatest values within half rows.
    A year without a peak has nulls."""
    w = along(keys, t).rowsBetween(-half, half)
    df = annual_max_mask(df, keys, t, level, min_dist)
    df = df.withColumns({f"_{c}": F.max(c).over(w) for c in [level, *others]})
    on = F.col("am").isNotNull()
    return df.groupBy(*keys, year(F.col(t)).alias("year")).agg(F.max(F.when(on, F.dayofyear(t).cast("long"))).alias("day"), *[F.max(F.when(on, F.col(f"_{c}"))).alias(c) for c in [level, *others]])


def drop_incomplete_years(df: DataFrame, keys: list[str], share: float, t: str = "t", x: str = "x", out: str = "x") -> DataFrame:
    """Nulls the values of years of which less than share of the days have one."""
    have = F.count(x).over(Window.partitionBy(*keys, year(F.col(t))))
    return df.withColumn(out, F.when(have / days_in_year(F.col(t)) >= share, F.col(x)))


def years_with_data(df: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(F.when(F.col(x).isNotNull(), F.year(t))).alias("years"))


def degenerate(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Keys whose values never change."""
    return df.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("spread")).where("spread = 0").drop("spread")


def exclude_period(df: DataFrame, start: str, end: str, t: str = "t", x: str = "x") -> DataFrame:
    """Nulls the values between two times, both included."""
    return df.withColumn(x, F.when(~F.col(t).between(F.lit(start).cast(df.schema[t].dataType), F.lit(end).cast(df.schema[t].dataType)), F.col(x)))


def annual_max_variation(df: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """Coefficient of variation of the yearly maxima (population deviation)."""
    return df.groupBy(*keys, year(F.col(t)).alias("year")).agg(F.max(x).alias("m")).groupBy(*keys).agg((F.stddev_pop("m") / F.avg("m")).alias("cv"))


def completeness(df: DataFrame, keys: list[str], expected_year: int, t: str = "t") -> DataFrame:
    """Keys (a file's name, say) whose newest time is not in the expected year."""
    return df.groupBy(*keys).agg(F.max(t).alias("newest")).where(F.year("newest") != expected_year)
