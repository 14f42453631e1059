"""Ranks, percentiles and scores of simulated against observed series. Missing is null; each function is one pass where it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extremes import values


def rank(df: DataFrame, keys: list[str], x: str = "x", method: str = "average", order: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Ranks from 1 of the values that aren't null. ordinal: ties by order."""
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.col(x).asc_nulls_last())
    same = F.count(x).over(Window.partitionBy(*keys, x))
    r = {
        "min": lambda: F.rank().over(up),
        "dense": lambda: F.dense_rank().over(up),
        "ordinal": lambda: F.row_number().over(w.orderBy(F.col(x).asc_nulls_last(), *(order or []))),
        "max": lambda: F.rank().over(up) + same - 1,
        "average": lambda: F.rank().over(up) + (same - 1) / 2,
    }[method]()
    return df.withColumn(out, F.when(F.col(x).isNotNull(), r.cast("double")))


def top(df: DataFrame, keys: list[str], n: int, x: str = "x", order: list[str] | None = None) -> DataFrame:
    """The n greatest rows of each series, with their place; null is never among them."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc(), *(order or []))
    return df.where(F.col(x).isNotNull()).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def above_kth(df: DataFrame, x: str, k: int) -> DataFrame:
    """Rows greater than the k-th greatest value (from 1) of the whole table; the threshold comes from a top-k, not a sort."""
    cut = df.where(F.col(x).isNotNull()).orderBy(F.col(x).desc()).limit(k).agg(F.min(x).alias("_cut"), F.count("*").alias("_n")).where(F.col("_n") == k)
    return df.crossJoin(F.broadcast(cut)).where(F.col(x) > F.col("_cut")).drop("_cut", "_n")


def percentile(df: DataFrame, keys: list[str], q: list[float], x: str = "x", method: str = "linear") -> DataFrame:
    """(keys, q, value): exact percentiles. linear, lower, higher, nearest (half to even) or midpoint."""
    w = Window.partitionBy(*keys)
    r = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), (F.row_number().over(w.orderBy(x)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    at = values(r, "q", q).withColumn("_at", (F.col("_n") - 1) * F.col("q") / 100)
    low, high = F.floor("_at"), F.ceil("_at")
    pick = lambda k: F.max(F.when(F.col("_i") == k, F.col("_x")))
    got = at.where(F.col("_i").between(low, high)).groupBy(*keys, "q").agg(pick(low).alias("_l"), pick(high).alias("_h"), pick(F.bround("_at")).alias("_m"), F.max(F.col("_at") - low).alias("_f"))
    value = {"linear": F.col("_l") + F.col("_f") * (F.col("_h") - F.col("_l")), "lower": F.col("_l"), "higher": F.col("_h"), "nearest": F.col("_m"), "midpoint": (F.col("_l") + F.col("_h")) / 2}[method]
    return got.select(*keys, "q", value.alias("value"))


def ecdf(df: DataFrame, keys: list[str], bins: list[float], x: str = "x") -> DataFrame:
    """(keys, bin, share): share of the values at most each bin."""
    shares = df.groupBy(*keys).agg(*[F.avg((F.col(x) <= b).cast("double")).alias(f"_{i}") for i, b in enumerate(bins)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bin"), F.col(f"_{i}").alias("share")) for i, b in enumerate(bins)])
    return shares.select(*keys, F.inline(pairs))


def preprocess_pair(df: DataFrame, keys: list[str], share: float = 0.9, t: str = "t", sim: str = "sim", obs: str = "obs") -> DataFrame:
    """Cuts each pair to the overlap of both series, nulls obs in incomplete years, and sim where obs is null."""
    from .series import drop_incomplete_years

    w = Window.partitionBy(*keys)
    end = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col(t))).over(w)
    df = df.withColumns({"_a": F.greatest(end(F.min, sim), end(F.min, obs)), "_b": F.least(end(F.max, sim), end(F.max, obs))})
    df = df.where(F.col(t).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    df = drop_incomplete_years(df, keys, share, t, obs, obs)
    return df.withColumn(sim, F.when(F.col(obs).isNotNull(), F.col(sim)))


def bias(s: Column, o: Column) -> Column:
    return F.try_divide(F.sum(s - o), F.count(o).cast("double"))


def percent_bias(s: Column, o: Column) -> Column:
    """A ratio, not times 100."""
    return F.try_divide(F.sum(s - o), F.sum(o))


def sse(s: Column, o: Column) -> Column:
    return F.sum((o - s) * (o - s))


def mse(s: Column, o: Column) -> Column:
    return F.avg((o - s) * (o - s))


def nash_sutcliffe(s: Column, o: Column) -> Column:
    """The denominator takes all observations, the numerator pairs."""
    return 1 - F.try_divide(sse(s, o), F.count(o) * F.var_pop(o))


def log_nash_sutcliffe(s: Column, o: Column, eps: float = 1e-6) -> Column:
    return nash_sutcliffe(F.log(s + eps), F.log(o + eps))


def pearson(s: Column, o: Column) -> Column:
    """Over pairs; equal to the moments of each series where both are masked alike."""
    return F.corr(s, o)


def pearson_own_moments(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """(keys, r): each series' mean and deviation over all its own values."""
    w = Window.partitionBy(*keys)
    off = lambda c: F.col(c) - F.avg(c).over(w)
    d = df.withColumn("_p", off(sim) * off(obs))
    return d.groupBy(*keys).agg(F.try_divide(F.avg("_p"), F.stddev_pop(sim) * F.stddev_pop(obs)).alias("r"))


def kling_gupta(s: Column, o: Column) -> dict[str, Column]:
    """kge and its parts: correlation, ratio of deviations, ratio of sums."""
    cc, var, total = F.corr(s, o), F.try_divide(F.stddev_pop(s), F.stddev_pop(o)), F.try_divide(F.sum(s), F.sum(o))
    return {"kge": 1 - F.sqrt((cc - 1) * (cc - 1) + (var - 1) * (var - 1) + (total - 1) * (total - 1)), "kge_pearson_coef": cc, "kge_rel_var": var, "kge_bias": total}


def spearman(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """(keys, n, r): average ranks of each series, then Pearson."""
    df = rank(df, keys, sim, out="_rs")
    df = rank(df, keys, obs, out="_ro")
    return df.groupBy(*keys).agg(F.count_if(F.col("_rs").isNotNull() & F.col("_ro").isNotNull()).alias("n"), F.corr("_rs", "_ro").alias("r"))


def t_statistic(r: Column, n: Column) -> Column:
    """Infinite for a perfect correlation, null for fewer than three pairs."""
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.signum(r) * F.lit(float("inf"))).otherwise(r * F.sqrt(F.try_divide(n - 2, 1 - r * r))))


def spearman_test(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """(keys, n, r, t, p): two-sided, n - 2 degrees of freedom, over pairs without nulls."""
    from ..functions.special import t_two_sided

    pairs = df.where(F.col(sim).isNotNull() & F.col(obs).isNotNull())
    out = spearman(pairs, keys, sim, obs).withColumn("t", t_statistic(F.col("r"), F.col("n")))
    return out.withColumn("p", t_two_sided("t", (F.col("n") - 2).cast("double")))


def t_test(df: DataFrame, keys: list[str], group: str, x: str = "x", with_p: bool = True) -> DataFrame:
    """(keys, a, b, t, df[, p]): pooled two-sample test of each two classes of group, a before b."""
    m = df.groupBy(*keys, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    side = lambda s: m.select(*keys, F.col(group).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in "nmv"])
    a, b = side("a"), side("b")
    both = (a.join(b, keys) if keys else a.crossJoin(b)).where("a < b")
    free = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / free
    out = both.select(*keys, "a", "b", ((F.col("m_a") - F.col("m_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"), free.alias("df"))
    if not with_p:
        return out
    from ..functions.special import t_two_sided

    return out.withColumn("p", t_two_sided("t", "df"))


def lag_correlation(df: DataFrame, keys: list[str], lags: list[int], t: str = "t", sim: str = "sim", obs: str = "obs", quantile: float | None = None) -> DataFrame:
    """(keys, lag, lag_rho): correlation of sim, moved by lag days, with obs. lag_rho is the greatest of all lags; lag its first
    place, null unless every lag has a correlation. quantile: only obs at or above it. Each series is sorted once by day and the
    lags come from a frame over it, so nothing but the series themselves is shuffled. t is a date that a series has once."""
    w, day = Window.partitionBy(*keys), F.datediff(t, F.lit("1970-01-01").cast("date"))
    r = df.select(*keys, day.alias("_d"), F.col(sim).alias("_s"), F.col(obs).alias("_o"))
    here = F.when(F.col("_s").isNotNull(), F.struct("_d", "_s"))
    r = r.withColumn("_near", F.collect_list(here).over(w.orderBy("_d").rangeBetween(-max(lags), -min(lags))))
    if quantile is not None:
        r = r.withColumn("_q", F.percentile("_o", quantile).over(w)).where("_o >= _q")
    moved = r.where("_o is not null").select(*keys, "_d", "_o", F.explode("_near").alias("_n")).select(*keys, (F.col("_d") - F.col("_n._d")).alias("lag"), F.col("_n._s").alias("_s"), "_o")
    rho = moved.where(F.col("lag").isin(list(lags))).groupBy(*keys, "lag").agg(F.corr("_s", "_o").alias("rho"))
    best = F.max_by(F.col("lag").cast("long"), F.struct(F.col("rho"), -F.col("lag")))
    return rho.groupBy(*keys).agg(F.when(F.count("rho") == len(lags), best).alias("lag"), F.max("rho").alias("lag_rho"))


def metrics(df: DataFrame, keys: list[str], lags: list[int], t: str = "t", sim: str = "sim", obs: str = "obs") -> DataFrame:
    """kge and its parts, nse, log_nse, rsquared in one aggregate, and the lag."""
    s, o = F.col(sim), F.col(obs)
    one = df.groupBy(*keys).agg(*[c.alias(k) for k, c in kling_gupta(s, o).items()], nash_sutcliffe(s, o).alias("nse"), log_nash_sutcliffe(s, o).alias("log_nse"), F.pow(pearson(s, o), F.lit(2.0)).alias("rsquared"))
    return one.join(lag_correlation(df, keys, lags, t, sim, obs), keys, "left")


def annual_max_metrics(df: DataFrame, keys: list[str], t: str = "t", sim: str = "sim", obs: str = "obs", min_dist: int = 30) -> DataFrame:
    """Scores of annual maxima and their days: am_bias, am_rank_corr, am_doy_diff, am_doy_corr, doy_uniform_p, doy_var.

    Both series go through the peaks as one table of twice the rows; all else is windows and one aggregate over its years.
    """
    from . import circular as C

    side = F.array(*[F.struct(F.lit(n).alias("_side"), F.col(c).alias("x")) for n, c in (("s", sim), ("o", obs))])
    days = C.flood_days(df.select(*keys, t, F.inline(side)), [*keys, "_side"], t, min_dist=min_dist)
    angle = C.doy_to_angle(F.col("doy"), F.col("year"))
    days = days.select(*keys, "_side", "year", F.col("annual_max").alias("_m"), angle.alias("_a"))
    pick = lambda n, c: F.max(F.when(F.col("_side") == n, F.col(c))).alias(f"{c}{n}")
    both = days.groupBy(*keys, "year").agg(pick("s", "_m"), pick("o", "_m"), pick("s", "_a"), pick("o", "_a")).withColumn("_ok", F.col("_ms").isNotNull() & F.col("_mo").isNotNull())
    w, ok = Window.partitionBy(*keys, "_ok"), F.col("_ok")
    off = lambda c: F.sin(F.col(c) - F.atan2(F.sum(F.sin(c)).over(w), F.sum(F.cos(c)).over(w)))
    both = both.withColumns({"_ds": off("_as"), "_do": off("_ao")})
    for c, out in (("_ms", "_rs"), ("_mo", "_ro")):
        both = rank(both, [*keys, "_ok"], c, out=out)
    s, o = F.col("_as"), F.col("_ao")
    got = both.groupBy(*keys).agg(
        percent_bias(F.col("_ms"), F.col("_mo")).alias("am_bias"),
        C.mean(s).alias("_mean_s"),
        C.mean(o).alias("_mean_o"),
        C.rayleigh(o).alias("doy_uniform_p"),
        C.variance(o).alias("doy_var"),
        F.corr(F.when(ok, F.col("_rs")), F.when(ok, F.col("_ro"))).alias("am_rank_corr"),
        F.try_divide(F.sum(F.when(ok, F.col("_ds") * F.col("_do"))), F.sqrt(F.sum(F.when(ok, F.col("_ds") * F.col("_ds"))) * F.sum(F.when(ok, F.col("_do") * F.col("_do"))))).alias("am_doy_corr"),
    )
    return got.withColumn("am_doy_diff", C.angle_diff(F.col("_mean_o"), F.col("_mean_s")) * 365 / (2 * C.PI)).drop("_mean_s", "_mean_o")
