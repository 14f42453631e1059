"""Extreme values: L-moment fits, return levels, plotting positions, their interpolation and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship

EULER = 0.5772156649015329


def values(df: DataFrame, column: str, items: list, kind: str = "double") -> DataFrame:
    """df times a short list, as an array in the plan."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(i).cast(kind) for i in items])))


def l_moments(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, n, b0, b1, b2, sd) of the values that aren't null."""
    w = Window.partitionBy(*keys)
    df = df.where(F.col(x).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(x)) - 1, "_n": F.count("*").over(w)})
    part = lambda *k: math.prod([F.col("_i") - j for j in k], start=F.col(x))
    n = F.max("_n")
    return df.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(x).alias("b0"),
        F.try_divide(F.sum(part(0)), (n * (n - 1)).cast("double")).alias("b1"),
        F.try_divide(F.sum(part(0, 1)), (n * (n - 1) * (n - 2)).cast("double")).alias("b2"),
        F.stddev_pop(x).alias("sd"),
    )


def _fit(m: DataFrame, dist: str, n_min: int) -> DataFrame:
    """Adds shape, loc and scale; null where there are fewer than n_min values or all are equal."""
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    l2 = 2 * b1 - b0
    ok = (F.col("n") >= n_min) & (F.col("sd") > 0)
    if dist == "gumbel":
        scale = l2 / math.log(2)
        fits = {"shape": F.lit(None).cast("double"), "loc": b0 - EULER * scale, "scale": scale}
    elif dist == "gpa":
        t3 = F.try_divide(6 * b2 - 6 * b1 + b0, l2)
        k = F.try_divide(1 - 3 * t3, 1 + t3)
        fits = {"shape": k, "loc": b0 - (2 + k) * l2, "scale": (1 + k) * (2 + k) * l2}
    else:
        raise ValueError(f"no such distribution: {dist}")
    return m.withColumns({name: F.when(ok, c) for name, c in fits.items()})


def fit(df: DataFrame, keys: list[str], x: str = "x", dist: str = "gumbel", n_min: int = 3) -> DataFrame:
    """(keys, n, b0, sd, shape, loc, scale). Hosking's signs for the shape."""
    return _fit(l_moments(df, keys, x), dist, n_min).select(*keys, "n", "b0", "sd", "shape", "loc", "scale")


def level(dist: str, period: Column, freq: Column) -> Column:
    """The value exceeded once in period, from columns shape, loc and scale."""
    p = freq / period
    if dist == "gumbel":
        return F.col("loc") - F.col("scale") * F.log(-F.log(1 - p))
    return F.when(F.abs("shape") < 1e-12, F.col("loc") - F.col("scale") * F.log(p)).otherwise(F.col("loc") + F.try_divide(F.col("scale"), F.col("shape")) * (1 - F.pow(p, "shape")))


def return_levels(df: DataFrame, keys: list[str], periods: list[float], x: str = "x", dist: str = "gumbel", n_min: int = 3, n_years: float | None = None) -> DataFrame:
    """(keys, T, level): fitted levels; where there is no fit, the mean of the values for every period."""
    fitted = values(fit(df, keys, x, dist, n_min), "T", periods)
    freq = F.col("n") / F.lit(float(n_years)) if n_years else F.lit(1.0)
    return fitted.select(*keys, "T", F.when(F.col("scale").isNull(), F.col("b0")).otherwise(level(dist, F.col("T"), freq)).alias("level"))


def plotting_positions(df: DataFrame, keys: list[str], x: str = "x", order: list[str] | None = None, n_years: float | None = None) -> DataFrame:
    """Adds period: 1 / (1 - rank / (n + 1)), by events a year if n_years is given; null values have none. Ties by order."""
    w = Window.partitionBy(*keys)
    n = F.count(x).over(w)
    rank = F.row_number().over(w.orderBy(F.col(x).asc_nulls_last(), *(order or [])))
    freq = n / F.lit(float(n_years)) if n_years else F.lit(1.0)
    return df.withColumn("period", F.when(F.col(x).isNotNull(), 1 / (1 - rank / (n + 1)) / freq))


def interpolate(targets: DataFrame, anchors: DataFrame, keys: list[str], at: str, a: str, b: str, clamp: bool, out: str) -> DataFrame:
    """targets with out: b interpolated at the column at; outside the anchors the end value (clamp) or null.

    Targets and anchors of a series are sorted together once and each target takes the anchor before and after it, so no target
    meets more than two anchors. All rows of targets stay, whatever nulls or repeats they hold. Anchors must differ in a.
    """
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    own = lambda df: [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(f"`{c}`") for c in targets.columns])
    marks = anchors.where(F.col(a).isNotNull()).select(*own(anchors), F.col(a).cast("double").alias("_at"), F.lit(0).alias("_g"), F.struct(F.col(a).cast("double").alias("a"), F.col(b).alias("b")).alias("_p"))
    both = marks.unionByName(targets.select(*own(targets), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_g"), row.alias("_r")), allowMissingColumns=True)
    before, after = (F.last("_p", True).over(w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)) for o in (("_at", "_g"), (F.desc("_at"), F.desc("_g"))))
    both = both.withColumns({"_b": before, "_c": after}).where("_g = 1")
    v, p, q = F.col("_at"), F.col("_b"), F.col("_c")
    end = lambda c: c if clamp else F.lit(None)
    y = F.when(v.isNull(), None).when(p["a"] == v, p["b"]).when(p.isNull(), end(q["b"])).when(q.isNull(), end(p["b"])).otherwise(p["b"] + (v - p["a"]) * (q["b"] - p["b"]) / (q["a"] - p["a"]))
    return both.select("_r.*", y.alias(out))


def periods_of_values(targets: DataFrame, peaks: DataFrame, keys: list[str], at: str, x: str = "x", out: str = "period") -> DataFrame:
    """Return period of each value, linear between plotting positions and clamped to their range."""
    p = plotting_positions(peaks.where(F.col(x).isNotNull()), keys, x).groupBy(*keys, x).agg(F.max("period").alias("_p"))
    return interpolate(targets, p, keys, at, x, "_p", True, out)


def values_of_periods(targets: DataFrame, peaks: DataFrame, keys: list[str], at: str, x: str = "x", out: str = "value") -> DataFrame:
    """Value of each return period, linear in its logarithm; null outside the plotting positions."""
    p = plotting_positions(peaks.where(F.col(x).isNotNull()), keys, x, [x]).select(*keys, F.log10("period").alias("_lp"), F.col(x).alias("_v"))
    return interpolate(targets.withColumn("_at", F.log10(at)), p, keys, "_at", "_lp", "_v", False, out).drop("_at")


def draw(keys: list[str], sample: Column, place: Column, n: Column, seed: int) -> Column:
    """Index below n for one draw of one sample: the first 8 hexadecimal digits of an MD5, so that any engine can repeat it."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], sample.cast("string"), place.cast("string"), F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), n.cast("long"))


def resample(df: DataFrame, keys: list[str], x: str, samples: int, seed: int = 42) -> DataFrame:
    """(keys, sample, place, x): samples of each series' values with replacement.

    Series are short (annual maxima): values are gathered by key once, and each sample draws from its own row's array, so
    the expansion happens after the shuffle and needs no join.
    """
    s = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("_v"))
    s = s.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("_v") - 1)))
    return s.select(*keys, "sample", "place", F.get("_v", draw(keys, F.col("sample"), F.col("place"), F.size("_v"), seed).cast("int")).alias(x))


def order_statistic(df: DataFrame, keys: list[str], x: str, alphas: list[float], samples: int) -> DataFrame:
    """(keys, alpha, x): the round((samples - 1) * alpha)-th smallest of each group, half to even."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(x)) - 1)
    at = values(ranked, "alpha", alphas)
    return at.where(F.col("_k") == F.bround(F.lit(float(samples - 1)) * F.col("alpha"))).select(*keys, "alpha", x)


STATISTICS = {"mean": lambda x: F.avg(x), "median": lambda x: F.percentile(x, 0.5), "std": lambda x: F.stddev_pop(x), "min": F.min, "max": F.max, "sum": lambda x: F.sum(x)}


def _left_out(statistic: str, v: Column) -> Column:
    """v: a series' sorted values as an array -> the statistic without each of them, in closed form."""
    n, at = F.size(v), F.sequence(F.lit(0), F.size(v) - 1)
    total = F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    if statistic == "sum":
        return F.transform(v, lambda e: total - e)
    if statistic == "mean":
        return F.transform(v, lambda e: (total - e) / (n - 1))
    if statistic == "std":
        off = F.transform(v, lambda e: e - total / n)
        squares = F.aggregate(off, F.lit(0.0), lambda s, e: s + e * e)
        return F.transform(off, lambda e: F.sqrt(F.greatest(F.lit(0.0), (squares - e * e) / (n - 1) - (e / (n - 1)) * (e / (n - 1)))))
    rest = lambda i, k: F.get(v, F.when(k < i, k).otherwise(k + 1).cast("int"))  # noqa: E731  the k-th of those left without i
    if statistic == "min":
        return F.transform(at, lambda i: rest(i, F.lit(0)))
    if statistic == "max":
        return F.transform(at, lambda i: rest(i, n - 2))
    return F.transform(at, lambda i: (rest(i, F.floor((n - 2) / 2)) + rest(i, F.ceil((n - 2) / 2))) / 2)


Statistic = str | Callable[[np.ndarray], float]


def _of_arrays(f: Callable[[np.ndarray], float], left_out: bool = False) -> Callable[[Column], Column]:
    """f of each array of a column, by Arrow batches; or of each array without each of its values in turn."""
    ship()

    def one(v: pd.Series) -> pd.Series:
        return pd.Series([float(f(np.asarray(a, float))) for a in v], dtype=float)

    def each(v: pd.Series) -> pd.Series:
        return pd.Series([[float(f(np.delete(np.asarray(a, float), i))) for i in range(len(a))] for a in v])

    return F.pandas_udf(each if left_out else one, "array<double>" if left_out else "double")


def _arrays(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, _v): each series' values, sorted."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(x).cast("double"))).alias("_v"))


def sample_statistics(df: DataFrame, keys: list[str], x: str, statistic: Statistic, samples: int, seed: int = 42) -> DataFrame:
    """(keys, sample, _s): the statistic, by name or any function of an array, of each sample. A function gets each sample as an array that
    is drawn in its row, so neither draws nor samples are shuffled."""
    if isinstance(statistic, str):
        return resample(df, keys, x, samples, seed).groupBy(*keys, "sample").agg(STATISTICS[statistic](x).alias("_s"))
    s = _arrays(df, keys, x).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = F.transform(F.sequence(F.lit(0), F.size("_v") - 1), lambda i: F.get("_v", draw(keys, F.col("sample"), i, F.size("_v"), seed).cast("int")))
    return s.select(*keys, "sample", _of_arrays(statistic)(drawn).alias("_s"))


def jackknife(df: DataFrame, keys: list[str], x: str = "x", statistic: Statistic = "mean") -> DataFrame:
    """(keys, x, left_out): the statistic of each series without one value, for each of its values that aren't null."""
    s = _arrays(df, keys, x)
    out = _left_out(statistic, F.col("_v")) if isinstance(statistic, str) else _of_arrays(statistic, True)(F.col("_v"))
    return s.where(F.size("_v") > 1).select(*keys, F.explode(F.arrays_zip(F.col("_v").alias("v"), out.alias("j"))).alias("_z")).select(*keys, F.col("_z.v").alias(x), F.col("_z.j").alias("left_out"))


def _acceleration(df: DataFrame, keys: list[str], x: str, statistic: Statistic) -> DataFrame:
    """(keys, _a) from the leave-one-out jackknife; null for one value or where all leave the same."""
    s = _arrays(df, keys, x).where(F.size("_v") > 1)
    s = s.select(*keys, (_left_out(statistic, F.col("_v")) if isinstance(statistic, str) else _of_arrays(statistic, True)(F.col("_v"))).alias("_j"))
    s = s.withColumn("_m", F.aggregate("_j", F.lit(0.0), lambda t, e: t + e) / F.size("_j"))
    power = lambda k: F.aggregate("_j", F.lit(0.0), lambda t, e: t + F.pow(F.col("_m") - e, F.lit(float(k))))
    return s.select(*keys, F.try_divide(power(3), 6 * F.pow(power(2), F.lit(1.5))).alias("_a"))


def confidence_interval(df: DataFrame, keys: list[str], x: str = "x", statistic: Statistic = "mean", alpha: float = 0.05, samples: int = 10_000, method: str = "bca", seed: int = 42) -> DataFrame:
    """(keys, alpha, bound): bootstrap interval at alpha / 2 and 1 - alpha / 2, by order statistics or bias-corrected and
    accelerated (true leave-one-out jackknife). statistic: a name of STATISTICS, or any function of an array of values."""
    boot = sample_statistics(df, keys, x, statistic, samples, seed)
    if method == "simple":
        return order_statistic(boot, keys, "_s", [alpha / 2, 1 - alpha / 2], samples).withColumnRenamed("_s", "bound")
    from ..functions.special import normal_cdf, normal_quantile

    named = isinstance(statistic, str)
    whole = df.groupBy(*keys).agg(STATISTICS[statistic](x).alias("_w")) if named else _arrays(df, keys, x).select(*keys, _of_arrays(statistic)(F.col("_v")).alias("_w"))
    accel = _acceleration(df, keys, x, statistic)
    z0 = boot.join(whole, keys).groupBy(*keys).agg(normal_share().alias("_share")).withColumn("_z0", normal_quantile("_share"))
    side = values(z0.join(accel, keys, "left"), "alpha", [alpha / 2, 1 - alpha / 2])
    z = F.col("_z0") + normal_quantile("alpha")
    side = side.withColumn("_at", normal_cdf(F.col("_z0") + z / (1 - F.coalesce("_a", F.lit(0.0)) * z)))
    ranked = boot.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_s")) - 1)
    return ranked.join(side, keys).where(F.col("_k") == F.bround((samples - 1) * F.col("_at"))).select(*keys, "alpha", F.col("_s").alias("bound"))


def normal_share() -> Column:
    """Share of samples below the whole's statistic; equal but for the order of a sum is not below."""
    return F.avg((F.col("_w") - F.col("_s") > 1e-12 * F.abs("_w")).cast("double"))


def jackknife_means(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Adds left_out: the mean of the other values, in closed form."""
    w = Window.partitionBy(*keys)
    return df.withColumn("left_out", F.try_divide(F.sum(x).over(w) - F.col(x), (F.count(x).over(w) - 1).cast("double")))


def level_intervals(df: DataFrame, keys: list[str], periods: list[float], x: str = "x", dist: str = "gumbel", alphas: tuple[float, ...] = (0.05, 0.95), samples: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, T, alpha, level): bootstrap intervals of return levels. The samples' parameters are shifted so that their mean
    is the fit to the data."""
    whole = fit(df, keys, x, dist).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("shape", "loc", "scale")])
    boot = fit(resample(df, keys, x, samples, seed), [*keys, "sample"], x, dist).join(whole, keys)
    w = Window.partitionBy(*keys)
    boot = boot.withColumns({c: F.col(c) + F.col(f"_{c}") - F.avg(c).over(w) for c in ("shape", "loc", "scale")})
    levels = values(boot, "T", periods).select(*keys, "T", level(dist, F.col("T"), F.lit(1.0)).alias("level"))
    return order_statistic(levels, [*keys, "T"], "level", list(alphas), samples)


def curve_intervals(df: DataFrame, keys: list[str], periods: list[float], x: str = "x", alphas: tuple[float, ...] = (0.05, 0.95), samples: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, T, alpha, value): bootstrap intervals of the empirical curve. Every sample has the same plotting positions."""
    boot = resample(df, keys, x, samples, seed)
    own = [*keys, "sample"]
    w = Window.partitionBy(*own)
    p = boot.withColumns({"_i": F.row_number().over(w.orderBy(x)), "_n": F.count("*").over(w)}).withColumn("_p", F.log10(1 / (1 - F.col("_i") / (F.col("_n") + 1))))
    s = p.withColumns({"_p1": F.lead("_p").over(w.orderBy("_i")), "_x1": F.lead(x).over(w.orderBy("_i"))})
    t = F.log10("T")
    s = values(s, "T", periods).where((t >= F.col("_p")) & ((t < F.col("_p1")) | (F.col("_p1").isNull() & (t == F.col("_p")))))
    got = s.select(*keys, "T", F.when(F.col("_p1").isNull(), F.col(x)).otherwise(F.col(x) + (t - F.col("_p")) * (F.col("_x1") - F.col(x)) / (F.col("_p1") - F.col("_p"))).alias("value"))
    return order_statistic(got, [*keys, "T"], "value", list(alphas), samples)
