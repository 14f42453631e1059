"""Queries over ranks, percentiles and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import skill as K
from ..operators.series import annual_max, peaks, rolling_max
from .data import DAILY, PAIRS, daily, pairs, rounded, table
from .registry import query
from .series import am_cte, peak_cte

KEY = ["k"]
LAGS = list(range(-10, 11))


def so():
    return F.col("sim"), F.col("obs")


def agg(spark, sf, **columns):
    return rounded(pairs(spark, sf).groupBy("k").agg(*[c.alias(n) for n, c in columns.items()]))


@query(f"WITH {PAIRS} SELECT k, round(sum(sim - obs) / count(obs), 4) AS bias, round(sum(sim - obs) / sum(obs), 6) AS pbias FROM p GROUP BY 1")
def skill_bias_pbias(spark, sf):
    return rounded(agg(spark, sf, bias=K.bias(*so()), pbias=K.percent_bias(*so())), 4, "bias")


@query(f"WITH {PAIRS}, m AS (SELECT k, avg(obs) AS mo FROM p GROUP BY 1) SELECT k, round(1 - sum((obs - sim) * (obs - sim)) / sum((obs - mo) * (obs - mo)), 6) AS nse FROM p JOIN m USING (k) GROUP BY 1")
def skill_nse(spark, sf):
    return agg(spark, sf, nse=K.nash_sutcliffe(*so()))


@query(f"WITH {PAIRS}, l AS (SELECT k, ln(sim + 1e-6) AS s, ln(obs + 1e-6) AS o FROM p), m AS (SELECT k, avg(o) AS mo FROM l GROUP BY 1) SELECT k, round(1 - sum((o - s) * (o - s)) / sum((o - mo) * (o - mo)), 6) AS log_nse FROM l JOIN m USING (k) GROUP BY 1")
def skill_lognse(spark, sf):
    return agg(spark, sf, log_nse=K.log_nash_sutcliffe(*so()))


@query(f"WITH {PAIRS} SELECT k, round(corr(sim, obs), 6) AS r, round(corr(sim, obs) * corr(sim, obs), 6) AS rsquared FROM p GROUP BY 1")
def skill_pearson_r2(spark, sf):
    return agg(spark, sf, r=K.pearson(*so()), rsquared=F.pow(K.pearson(*so()), F.lit(2.0)))


@query(f"WITH {PAIRS}, m AS (SELECT k, avg(sim) AS ms, avg(obs) AS mo, stddev_pop(sim) AS ss, stddev_pop(obs) AS so FROM p GROUP BY 1) SELECT k, round(avg((sim - ms) * (obs - mo)) / any_value(ss) / any_value(so), 6) AS r FROM p JOIN m USING (k) GROUP BY 1")
def skill_pearson_own_moments(spark, sf):
    return rounded(K.pearson_own_moments(pairs(spark, sf), KEY))


RANKS = """rk AS (SELECT k, t, sim, obs, CASE WHEN sim IS NOT NULL THEN rank() OVER (PARTITION BY k ORDER BY sim NULLS LAST) + (count(*) OVER (PARTITION BY k, sim) - 1) / 2e0 END AS rs,
CASE WHEN obs IS NOT NULL THEN rank() OVER (PARTITION BY k ORDER BY obs NULLS LAST) + (count(*) OVER (PARTITION BY k, obs) - 1) / 2e0 END AS ro FROM {0})"""


@query(f"WITH {PAIRS}, {RANKS.format('p')} SELECT k, count(CASE WHEN rs IS NOT NULL AND ro IS NOT NULL THEN 1 END) AS n, round(corr(rs, ro), 6) AS r FROM rk GROUP BY 1")
def skill_spearman(spark, sf):
    return rounded(K.spearman(pairs(spark, sf), KEY))


@query(f"WITH {PAIRS}, q AS (SELECT * FROM p WHERE sim IS NOT NULL AND obs IS NOT NULL), {RANKS.format('q')}, c AS (SELECT k, count(*) AS n, corr(rs, ro) AS r FROM rk GROUP BY 1) SELECT k, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM c")
def spearman_t(spark, sf):
    return rounded(K.spearman_test(pairs(spark, sf), KEY).drop("p"))


def t_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom over 1, by the finite sums of its distribution function."""
    c2, s = f"(1 / (1 + {t} * {t} / {df}))", f"(abs({t}) / sqrt({df} + {t} * {t}))"
    terms = lambda n, f: f"list_sum(list_transform(range(0, CAST({n} AS BIGINT)), lambda i: {f}))"
    even = terms(f"{df} / 2", f"exp(lgamma(i + 0.5e0) - lgamma(i + 1e0) + i * ln({c2})) / sqrt(pi())")
    odd = terms(f"({df} - 1) / 2", f"exp(lgamma(i + 1e0) - lgamma(i + 1.5e0) + i * ln({c2})) * sqrt(pi()) / 2")
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {s} * {even} ELSE 2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c2}) * {odd}) END)"


@query(f"WITH {PAIRS}, q AS (SELECT * FROM p WHERE sim IS NOT NULL AND obs IS NOT NULL), {RANKS.format('q')}, c AS (SELECT k, count(*) - 2e0 AS df, corr(rs, ro) AS r FROM rk GROUP BY 1), u AS (SELECT k, df, r * sqrt(df / (1 - r * r)) AS t FROM c) SELECT k, round({t_sql('t', 'df')}, 6) AS p FROM u")
def spearman_p(spark, sf):
    return rounded(K.spearman_test(pairs(spark, sf), KEY).select("k", "p"))


@query(f"WITH {PAIRS} SELECT k, round(sum((obs - sim) * (obs - sim)), -3) AS sse, round(sqrt(sum((obs - sim) * (obs - sim))), 3) AS root_sse, round(avg((obs - sim) * (obs - sim)), 0) AS mse, round(sqrt(avg((obs - sim) * (obs - sim))), 4) AS rmse FROM p GROUP BY 1")
def skill_sse_rmse(spark, sf):
    e, m = K.sse(*so()), K.mse(*so())
    return pairs(spark, sf).groupBy("k").agg(F.round(e, -3).alias("sse"), F.round(F.sqrt(e), 3).alias("root_sse"), F.round(m, 0).alias("mse"), F.round(F.sqrt(m), 4).alias("rmse"))


KGE = "kg AS (SELECT k, corr(sim, obs) AS cc, stddev_pop(sim) / stddev_pop(obs) AS a, sum(sim) / sum(obs) AS b FROM p GROUP BY 1)"


@query(f"WITH {PAIRS}, {KGE} SELECT k, round(1 - sqrt(pow(cc - 1, 2) + pow(a - 1, 2) + pow(b - 1, 2)), 6) AS kge, round(cc, 6) AS kge_pearson_coef, round(a, 6) AS kge_rel_var, round(b, 6) AS kge_bias FROM kg")
def skill_kge(spark, sf):
    return agg(spark, sf, **K.kling_gupta(*so()))


PRE = """ov AS (SELECT k, greatest(min(CASE WHEN sim IS NOT NULL THEN t END), min(CASE WHEN obs IS NOT NULL THEN t END)) AS a, least(max(CASE WHEN sim IS NOT NULL THEN t END), max(CASE WHEN obs IS NOT NULL THEN t END)) AS b FROM p GROUP BY 1),
c0 AS (SELECT p.* FROM p JOIN ov ON ov.k = p.k AND p.t BETWEEN a AND b),
c1 AS (SELECT k, t, sim, CASE WHEN count(obs) OVER (PARTITION BY k, year(t)) * 1e0 / date_diff('day', make_date(year(t), 1, 1), make_date(year(t) + 1, 1, 1)) >= 0.9 THEN obs END AS obs FROM c0),
c2 AS (SELECT k, t, CASE WHEN obs IS NOT NULL THEN sim END AS sim, obs FROM c1)"""


@query(f"WITH {PAIRS}, {PRE} SELECT k, t, sim, obs FROM c2", dates=("t",))
def preprocess_pair(spark, sf):
    return K.preprocess_pair(pairs(spark, sf), KEY).select("k", "t", "sim", "obs")


LAG = """lg AS (SELECT s.k, l.l AS lag, corr(s.sim, o.obs) AS rho FROM (SELECT * FROM {0} WHERE sim IS NOT NULL) s CROSS JOIN (SELECT CAST(unnest(range(-10, 11)) AS INT) AS l) l JOIN (SELECT * FROM {0} WHERE obs IS NOT NULL) o ON o.k = s.k AND o.t = s.t + l.l GROUP BY 1, 2),
lb AS (SELECT k, CASE WHEN count(rho) = 21 THEN CAST(arg_max(lag, (rho, -lag)) AS BIGINT) END AS lag, max(rho) AS lag_rho FROM lg GROUP BY 1)"""


@query(f"WITH {PAIRS}, {LAG.format('p')} SELECT k, lag, round(lag_rho, 6) AS lag_rho FROM lb")
def lag_crosscorr(spark, sf):
    return rounded(K.lag_correlation(pairs(spark, sf), KEY, LAGS))


@query(
    f"""WITH {PAIRS}, {PRE}, {LAG.format("c2")}, kg AS (SELECT k, corr(sim, obs) AS cc, stddev_pop(sim) / stddev_pop(obs) AS a, sum(sim) / sum(obs) AS b, sum((obs - sim) * (obs - sim)) AS e, var_pop(obs) * count(obs) AS v FROM c2 GROUP BY 1),
ll AS (SELECT k, sum(pow(ln(obs + 1e-6) - ln(sim + 1e-6), 2)) AS e, var_pop(ln(obs + 1e-6)) * count(obs) AS v FROM c2 GROUP BY 1)
SELECT kg.k, round(1 - sqrt(pow(cc - 1, 2) + pow(a - 1, 2) + pow(b - 1, 2)), 6) AS kge, round(cc, 6) AS kge_pearson_coef, round(a, 6) AS kge_rel_var, round(b, 6) AS kge_bias, round(1 - kg.e / kg.v, 6) AS nse, round(1 - ll.e / ll.v, 6) AS log_nse, round(cc * cc, 6) AS rsquared, lag, round(lag_rho, 6) AS lag_rho
FROM kg JOIN ll USING (k) JOIN lb USING (k)"""
)
def skill_bundle(spark, sf):
    return rounded(K.metrics(K.preprocess_pair(pairs(spark, sf), KEY), KEY, LAGS))


def _rank(method: str, expression: str):
    def f(spark, sf):
        p = pairs(spark, sf).select("k", "t", F.floor(F.col("obs") / 50000).cast("double").alias("x"))
        return K.rank(p, KEY, method=method, order=["t"]).select("k", "t", "x", "rank")

    query(f"WITH {PAIRS}, q AS (SELECT k, t, floor(obs / 50000) AS x FROM p) SELECT k, t, x, CASE WHEN x IS NOT NULL THEN CAST({expression} AS DOUBLE) END AS rank FROM q", name=f"rank_{method}", dates=("t",))(f)


_rank("average", "rank() OVER (PARTITION BY k ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY k, x) - 1) / 2e0")
_rank("min", "rank() OVER (PARTITION BY k ORDER BY x NULLS LAST)")
_rank("max", "rank() OVER (PARTITION BY k ORDER BY x NULLS LAST) + count(*) OVER (PARTITION BY k, x) - 1")
_rank("dense", "dense_rank() OVER (PARTITION BY k ORDER BY x NULLS LAST)")
_rank("ordinal", "row_number() OVER (PARTITION BY k ORDER BY x NULLS LAST, t)")


@query(f"WITH {PAIRS}, r AS (SELECT k, t, obs, row_number() OVER (PARTITION BY k ORDER BY obs DESC, t) AS place FROM p WHERE obs IS NOT NULL) SELECT * FROM r WHERE place <= 50", dates=("t",))
def topn_idx(spark, sf):
    return K.top(pairs(spark, sf).drop("sim"), KEY, 50, "obs", ["t"])


def _percentile(method: str, value: str):
    def f(spark, sf):
        return rounded(K.percentile(pairs(spark, sf), KEY, [5, 37.3, 50, 75, 99.5, 100], "obs", method), 4, "value")

    sql = f"""WITH {PAIRS}, a AS (SELECT k, list_sort(list(obs) FILTER (obs IS NOT NULL)) AS v FROM p GROUP BY 1),
b AS (SELECT k, v, q.q, (len(v) - 1) * q.q / 100 AS pos FROM a CROSS JOIN (SELECT unnest([5e0, 37.3e0, 50e0, 75e0, 99.5e0, 100e0]) AS q) q) SELECT k, q, round({value}, 4) AS value FROM b"""
    query(sql, name=f"nanpercentile_{method}")(f)


LOW, HIGH = "v[CAST(floor(pos) AS INT) + 1]", "v[CAST(ceil(pos) AS INT) + 1]"
_percentile("linear", f"{LOW} + (pos - floor(pos)) * ({HIGH} - {LOW})")
_percentile("lower", LOW)
_percentile("higher", HIGH)
_percentile("nearest", "v[CAST(round_even(pos, 0) AS INT) + 1]")
_percentile("midpoint", f"({LOW} + {HIGH}) / 2")


@query(f"WITH {DAILY} SELECT k, b.b AS bin, round(avg(CASE WHEN x <= b.b THEN 1e0 ELSE 0e0 END), 6) AS share FROM d CROSS JOIN (SELECT unnest([0e0, 50000e0, 200000e0, 1000000e0]) AS b) b GROUP BY 1, 2")
def ecdf_bins(spark, sf):
    return rounded(K.ecdf(daily(spark, sf), KEY, [0, 50000, 200000, 1000000]))


@query(f"WITH {DAILY} SELECT k, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS low, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, max(x) AS high FROM d GROUP BY 1")
def describe_quartiles(spark, sf):
    q = lambda p: F.percentile("x", p)
    return rounded(daily(spark, sf).groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("x").alias("high")), 4)


@query(
    f"""WITH {DAILY}, {peak_cte(7)}, q AS (SELECT k, quantile_cont(x, 0.75) AS cut FROM d GROUP BY 1) SELECT pk.k, t, peak FROM pk JOIN q USING (k) WHERE peak > cut""", dates=("t",)
)
def peaks_above_quartile(spark, sf):
    d = daily(spark, sf)
    cut = d.groupBy("k").agg(F.percentile("x", 0.75).alias("cut"))
    return peaks(d, KEY, min_dist=7).join(cut, "k").where("peak > cut").select("k", "t", "peak")


@query("WITH r AS (SELECT o_orderkey, o_totalprice, (SELECT min(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 200)) AS cut FROM orders) SELECT o_orderkey, o_totalprice FROM r WHERE o_totalprice > cut")
def kth_threshold_filter(spark, sf):
    return K.above_kth(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 200)


#: Queries over a table as one series, which no task holds (`operators.ordered`).
_ONE = "o AS (SELECT o_orderkey AS t, o_totalprice AS x FROM orders)"


def _one(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("x"))


@query(f"WITH {_ONE} SELECT t, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rank FROM o")
def long_rank(spark, sf):
    return O.rank(_one(spark, sf), [], "x")


@query(f"WITH {_ONE}, v AS (SELECT list_sort(list(x)) AS v FROM o), b AS (SELECT v, q, (len(v) - 1) * q / 100 AS pos FROM v CROSS JOIN (SELECT unnest([0e0, 37.3e0, 50e0, 99.9e0, 100e0]) AS q)) SELECT q, round({LOW} + (pos - floor(pos)) * ({HIGH} - {LOW}), 4) AS value FROM b")
def long_percentile(spark, sf):
    return rounded(O.percentile(_one(spark, sf), [], [0, 37.3, 50, 99.9, 100], "x"), 4, "value")


@query(f"WITH {_ONE} SELECT t, x FROM o WHERE x > (SELECT x FROM o ORDER BY x DESC LIMIT 1 OFFSET 999)")
def long_above_kth(spark, sf):
    return O.above_kth(_one(spark, sf), "x", 1000)


@query(
    f"""WITH {_ONE}, p AS (SELECT t, x, CASE WHEN x > lag(x) OVER (ORDER BY t) AND lead(x) OVER (ORDER BY t) <= x THEN x END AS p FROM o),
m AS (SELECT *, max(p) OVER (ORDER BY t ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS m FROM p) SELECT t, p AS peak FROM m WHERE p = m"""
)
def long_peaks(spark, sf):
    return O.in_blocks(_one(spark, sf), [], ["t"], lambda d, keys: peaks(d, keys, min_dist=30), 31, 5000).where("peak is not null").select("t", "peak")


@query(f"WITH {_ONE} SELECT t, max(x) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS rolled FROM o")
def long_rolling_max(spark, sf):
    return O.in_blocks(_one(spark, sf), [], ["t"], lambda d, keys: rolling_max(d, keys, 9), 9, 5000).select("t", "rolled")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


TT = """m AS (SELECT k, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 1),
tt AS (SELECT a.k AS a, b.k AS b, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1e0 / a.n + 1e0 / b.n)) AS t, CAST(a.n + b.n - 2 AS DOUBLE) AS df FROM m a JOIN m b ON a.k < b.k)"""


@query(f"WITH {DAILY}, {TT} SELECT a, b, round(t, 6) AS t, df FROM tt")
def ttest_t(spark, sf):
    return rounded(K.t_test(daily(spark, sf), [], "k", with_p=False))


@query(f"WITH {DAILY}, {TT} SELECT a, b, round({t_sql('t', 'df')}, 6) AS p FROM tt")
def ttest_p(spark, sf):
    return rounded(K.t_test(daily(spark, sf), [], "k").select("a", "b", "p"))


@query(f"WITH {DAILY}, {am_cte(14)} SELECT k, year, am, CAST(row_number() OVER (PARTITION BY k ORDER BY am, year) AS DOUBLE) AS rank FROM am WHERE am IS NOT NULL")
def annual_max_ranks(spark, sf):
    return K.rank(annual_max(daily(spark, sf), KEY, min_dist=14).where("am is not null"), KEY, "am", "ordinal", ["year"])
