"""Streams of observations. An addition: the batch operators define the results, and a stream that has ended gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDUCE = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count}


def resample(stream: DataFrame, keys: list[str], unit: str = "1 day", late: str = "1 hour", how: tuple[str, ...] = ("max", "min", "mean"), t: str = "t", x: str = "x") -> DataFrame:
    """(keys, t, x_<how>) by window of event time; a window closes when the watermark passes it, and then its state goes."""
    w = stream.withWatermark(t, late).groupBy(F.window(t, unit), *keys).agg(*[REDUCE[h](x).alias(f"{x}_{h}") for h in how])
    return w.select(*keys, F.col("window.start").alias(t), *[f"{x}_{h}" for h in how])


def exceedances(stream: DataFrame, keys: list[str], threshold: float, gap: str = "2 days", late: str = "1 hour", t: str = "t", x: str = "x") -> DataFrame:
    """(keys, start, end, peak, n): runs of values over the threshold with no pause longer than gap."""
    s = stream.withWatermark(t, late).where(F.col(x) > threshold).groupBy(F.session_window(t, gap), *keys).agg(F.max(x).alias("peak"), F.count("*").alias("n"))
    return s.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "peak", "n")
