"""Queries over peaks, annual maxima, completeness and extreme values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extremes as E
from ..operators import series as S
from .data import CELLS, DAILY, PAIRS, cells, daily, pairs, rounded, table
from .registry import query

K = ["k"]


def peak_cte(d: int = 1, source: str = "d", x: str = "x", keys: str = "k") -> str:
    """CTEs pk0 (candidates) and pk (after suppression), written from the definition."""
    return f"""pk0 AS (SELECT *, CASE WHEN {x} > lag({x}) OVER w AND lead({x}) OVER w <= {x} THEN {x} END AS c FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
pk AS (SELECT *, {"c" if d == 1 else f"CASE WHEN c = max(c) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN {d} PRECEDING AND {d - 1} FOLLOWING) THEN c END"} AS peak FROM pk0)"""


def am_cte(d: int) -> str:
    return peak_cte(d) + ", am AS (SELECT k, CAST(year(t) AS BIGINT) AS year, max(peak) AS am FROM pk GROUP BY 1, 2)"


@query(f"WITH {DAILY}, {peak_cte()} SELECT k, t, peak FROM pk WHERE peak IS NOT NULL", dates=("t",))
def peaks_basic(spark, sf):
    return S.peaks(daily(spark, sf), K).where("peak is not null").select("k", "t", "peak")


@query(f"WITH {DAILY}, {peak_cte(14)} SELECT k, t, peak FROM pk WHERE peak IS NOT NULL", dates=("t",))
def peaks_min_dist(spark, sf):
    return S.peaks(daily(spark, sf), K, min_dist=14).where("peak is not null").select("k", "t", "peak")


@query(f"WITH {DAILY}, s AS (SELECT k, t, CASE WHEN x > lag(x) OVER w THEN 1e0 WHEN x <= lag(x) OVER w THEN -1e0 END AS trend FROM d WINDOW w AS (PARTITION BY k ORDER BY t)) SELECT k, trend, count(*) AS n FROM s GROUP BY 1, 2")
def trend_signs(spark, sf):
    return daily(spark, sf).withColumn("trend", S.rising(F.col("x"), K, "t")).groupBy("k", "trend").agg(F.count("*").alias("n"))


@query(f"WITH {DAILY}, {peak_cte(7)} SELECT k, t, peak FROM pk WHERE peak > 200000", dates=("t",))
def peaks_over_threshold(spark, sf):
    return S.peaks_over_threshold(daily(spark, sf), K, 200000.0, min_dist=7).select("k", "t", "peak")


@query(f"WITH {DAILY}, {am_cte(14)} SELECT k, year, am FROM am")
def annual_max_reduce(spark, sf):
    return S.annual_max(daily(spark, sf), K, min_dist=14)


@query(f"WITH {DAILY}, {peak_cte(14)}, m AS (SELECT *, max(peak) OVER (PARTITION BY k, year(t)) AS top FROM pk) SELECT k, t, peak AS am FROM m WHERE peak = top", dates=("t",))
def annual_max_mask(spark, sf):
    return S.annual_max_mask(daily(spark, sf), K, min_dist=14).where("am is not null").select("k", "t", "am")


@query(f"WITH {DAILY} SELECT k, t, max(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS rolled FROM d", dates=("t",))
def rolling_max_centered(spark, sf):
    return S.rolling_max(daily(spark, sf), K, 5).select("k", "t", "rolled")


@query(
    f"""WITH {PAIRS}, q AS (SELECT k, t, coalesce(sim, 0e0) AS x, obs FROM p), {peak_cte(30, "q")},
m AS (SELECT *, max(peak) OVER (PARTITION BY k, year(t)) AS top, max(x) OVER w AS rx, max(obs) OVER w AS ro FROM pk WINDOW w AS (PARTITION BY k ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT k, CAST(year(t) AS BIGINT) AS year, CAST(max(CASE WHEN peak = top THEN dayofyear(t) END) AS BIGINT) AS day, max(CASE WHEN peak = top THEN rx END) AS x, max(CASE WHEN peak = top THEN ro END) AS obs FROM m GROUP BY 1, 2"""
)
def driver_extraction(spark, sf):
    p = pairs(spark, sf).select("k", "t", F.coalesce("sim", F.lit(0.0)).alias("x"), "obs")
    return S.drivers(p, K, "x", ["obs"])


@query(f"WITH {DAILY}, y AS (SELECT k, year(t) AS y, max(x) AS m FROM d GROUP BY 1, 2) SELECT k, round(stddev_pop(m) / avg(m), 6) AS cv FROM y GROUP BY 1")
def annual_max_cv(spark, sf):
    return rounded(S.annual_max_variation(daily(spark, sf), K))


@query(
    f"""WITH {PAIRS}, y AS (SELECT *, count(obs) OVER (PARTITION BY k, year(t)) AS n, date_diff('day', make_date(year(t), 1, 1), make_date(year(t) + 1, 1, 1)) AS days FROM p)
SELECT k, t, CASE WHEN n * 1e0 / days >= 0.9 THEN obs END AS obs FROM y""",
    dates=("t",),
)
def drop_incomplete_years(spark, sf):
    return S.drop_incomplete_years(pairs(spark, sf), K, 0.9, x="obs", out="obs").select("k", "t", "obs")


@query(f"WITH {PAIRS} SELECT k, count(DISTINCT CASE WHEN obs IS NOT NULL THEN year(t) END) AS years FROM p GROUP BY 1")
def years_with_data(spark, sf):
    return S.years_with_data(pairs(spark, sf), K, x="obs")


@query("WITH s AS (SELECT l_partkey % 600 AS k, CASE WHEN l_partkey % 3 = 0 THEN 1e0 ELSE l_quantity END AS x FROM lineitem) SELECT k FROM s GROUP BY k HAVING max(x) - min(x) = 0")
def degenerate_series(spark, sf):
    k = F.col("l_partkey")
    return S.degenerate(table(spark, sf, "lineitem").select((k % 600).alias("k"), F.when(k % 3 == 0, 1.0).otherwise(F.col("l_quantity")).alias("x")), K)


@query(f"WITH {DAILY} SELECT k, count(CASE WHEN NOT t BETWEEN DATE '1996-10-01' AND DATE '1997-03-31' THEN x END) AS n, round(sum(CASE WHEN NOT t BETWEEN DATE '1996-10-01' AND DATE '1997-03-31' THEN x END), 2) AS total FROM d GROUP BY 1")
def exclude_period(spark, sf):
    return S.exclude_period(daily(spark, sf), "1996-10-01", "1997-03-31").groupBy("k").agg(F.count("x").alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query("SELECT o_orderstatus AS k, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1 HAVING year(max(o_orderdate)) <> 2002", dates=("newest",))
def completeness_scan(spark, sf):
    return S.completeness(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_orderdate").cast("date").alias("t")), K, 2002)


LM = """r AS (SELECT k, am AS v, row_number() OVER (PARTITION BY k ORDER BY am) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM am WHERE am IS NOT NULL),
lm AS (SELECT k, max(n) AS n, avg(v) AS b0, sum(i * v) / nullif(max(n) * (max(n) - 1), 0) AS b1, sum(i * (i - 1) * v) / nullif(max(n) * (max(n) - 1) * (max(n) - 2), 0) AS b2, stddev_pop(v) AS sd FROM r GROUP BY 1)"""
GUMBEL = LM + ", f AS (SELECT *, (2 * b1 - b0) / ln(2e0) AS scale, b0 - 0.5772156649015329e0 * (2 * b1 - b0) / ln(2e0) AS loc FROM lm)"
PERIODS = [1.1, 1.5, 2, 5, 10, 20, 30, 50, 100]
PERIOD_SQL = "(SELECT unnest([1.1e0, 1.5e0, 2e0, 5e0, 10e0, 20e0, 30e0, 50e0, 100e0]) AS T)"


@query(f"WITH {DAILY}, {am_cte(14)}, {GUMBEL} SELECT k, n, round(loc, 4) AS loc, round(scale, 4) AS scale FROM f")
def gumbel_params(spark, sf):
    return rounded(E.fit(S.annual_max(daily(spark, sf), K, min_dist=14), K, "am").select("k", "n", "loc", "scale"), 4)


@query(f'WITH {DAILY}, {am_cte(14)}, {GUMBEL} SELECT k, p.T AS "T", round(loc - scale * ln(-ln(1 - 1 / p.T)), 4) AS level FROM f CROSS JOIN {PERIOD_SQL} p')
def gumbel_return_levels(spark, sf):
    return rounded(E.return_levels(S.annual_max(daily(spark, sf), K, min_dist=14), K, PERIODS, "am"), 4, "level")


@query(f'WITH {DAILY}, {am_cte(14)}, {GUMBEL} SELECT k, p.T AS "T", round(loc - scale * ln(-ln(1 - (n / 10e0) / p.T)), 4) AS level FROM f CROSS JOIN {PERIOD_SQL} p')
def gumbel_levels_by_years(spark, sf):
    return rounded(E.return_levels(S.annual_max(daily(spark, sf), K, min_dist=14), K, PERIODS, "am", n_years=10), 4, "level")


@query(f'WITH {DAILY}, {am_cte(14)}, {LM} SELECT k, p.T AS "T", round(b0, 4) AS level FROM lm CROSS JOIN {PERIOD_SQL} p')
def gumbel_nmin_fallback(spark, sf):
    return rounded(E.return_levels(S.annual_max(daily(spark, sf), K, min_dist=14), K, PERIODS, "am", n_min=1000), 4, "level")


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {LM}, a AS (SELECT *, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM lm),
f AS (SELECT *, (1 - 3 * t3) / (1 + t3) AS h FROM a)
SELECT k, p.T AS "T", round(b0 - (2 + h) * l2 + (1 + h) * (2 + h) * l2 / h * (1 - pow(1 / p.T, h)), 3) AS level FROM f CROSS JOIN {PERIOD_SQL} p"""
)
def gpa_return_levels(spark, sf):
    return rounded(E.return_levels(S.annual_max(daily(spark, sf), K, min_dist=14), K, PERIODS, "am", "gpa"), 3, "level")


@query(
    f"""WITH {CELLS}, s AS (SELECT row, col, y.y AS year, value * (1 + ((row * 31 + col * 17 + y.y * 13) % 23) / 23e0) AS am FROM c CROSS JOIN (SELECT unnest(range(0, 35)) AS y) y),
r AS (SELECT row, col, am AS v, row_number() OVER (PARTITION BY row, col ORDER BY am) - 1 AS i FROM s),
lm AS (SELECT row, col, avg(v) AS b0, sum(i * v) / (35 * 34) AS b1 FROM r GROUP BY 1, 2)
SELECT row, col, p.T AS "T", round(b0 - 0.5772156649015329e0 * (2 * b1 - b0) / ln(2e0) - (2 * b1 - b0) / ln(2e0) * ln(-ln(1 - 1 / p.T)), 4) AS level FROM lm CROSS JOIN (SELECT unnest([10e0, 100e0]) AS T) p"""
)
def ev_grid(spark, sf):
    c = cells(spark, sf).withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(34))))
    s = c.withColumn("am", F.col("value") * (1 + ((F.col("row") * 31 + F.col("col") * 17 + F.col("year") * 13) % 23) / 23.0))
    return rounded(E.return_levels(s, ["row", "col"], [10, 100], "am", n_min=30), 4, "level")


WEIBULL = "wb AS (SELECT k, year, am, 1 / (1 - row_number() OVER (PARTITION BY k ORDER BY am, year) / (count(*) OVER (PARTITION BY k) + 1e0)) AS period FROM am WHERE am IS NOT NULL)"


@query(f"WITH {DAILY}, {am_cte(14)}, {WEIBULL} SELECT k, year, am, round(period, 6) AS period FROM wb")
def weibull_return_period(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14).where("am is not null")
    return rounded(E.plotting_positions(am, K, "am", ["year"]), 6, "period")


VALUES_SQL = "(SELECT unnest([100000e0, 150000e0, 250000e0, 400000e0, 3000000e0]) AS v)"


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {WEIBULL}, a AS (SELECT k, am, max(period) AS period FROM wb GROUP BY 1, 2),
s AS (SELECT k, am AS a0, period AS p0, lead(am) OVER (PARTITION BY k ORDER BY am) AS a1, lead(period) OVER (PARTITION BY k ORDER BY am) AS p1, min(am) OVER (PARTITION BY k) AS lo, max(am) OVER (PARTITION BY k) AS hi FROM a),
g AS (SELECT DISTINCT k, v.v AS at FROM am CROSS JOIN {VALUES_SQL} v)
SELECT g.k, g.at, round(max(CASE WHEN g.at <= lo AND s.a0 = lo THEN p0 WHEN g.at >= hi AND s.a0 = hi THEN p0 WHEN g.at >= a0 AND g.at < a1 THEN p0 + (g.at - a0) * (p1 - p0) / (a1 - a0) END), 6) AS period
FROM g JOIN s ON s.k = g.k GROUP BY 1, 2"""
)
def interp_ev(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    targets = E.values(am.select("k").distinct(), "at", [100000, 150000, 250000, 400000, 3000000])
    return rounded(E.periods_of_values(targets, am, K, "at", "am"), 6, "period")


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {WEIBULL},
s AS (SELECT k, log10(period) AS p0, am AS a0, lead(log10(period)) OVER w AS p1, lead(am) OVER w AS a1 FROM wb WINDOW w AS (PARTITION BY k ORDER BY period)),
g AS (SELECT DISTINCT k, t.T AS at FROM am CROSS JOIN (SELECT unnest([1.05e0, 1.5e0, 2.5e0, 5e0, 1000e0]) AS T) t)
SELECT g.k, g.at AS period, round(max(CASE WHEN log10(g.at) >= p0 AND log10(g.at) < p1 THEN a0 + (log10(g.at) - p0) * (a1 - a0) / (p1 - p0) END), 4) AS value FROM g JOIN s ON s.k = g.k GROUP BY 1, 2"""
)
def interp_rps(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    targets = E.values(am.select("k").distinct(), "period", [1.05, 1.5, 2.5, 5, 1000])
    return rounded(E.values_of_periods(targets, am, K, "period", "am"), 4, "value")


BOOT = """v AS (SELECT k, am, row_number() OVER (PARTITION BY k ORDER BY am) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM am WHERE am IS NOT NULL),
bs AS (SELECT v.k, b, i, CAST(('0x' || substr(md5(concat_ws('-', v.k, b, i, 42)), 1, 8)) AS BIGINT) % n AS j FROM (SELECT DISTINCT k, n FROM v) v, (SELECT unnest(range(0, 200)) AS b), LATERAL (SELECT unnest(range(0, v.n)) AS i)),
bt AS (SELECT bs.k, bs.b, bs.i, v.am FROM bs JOIN v ON v.k = bs.k AND v.j = bs.j)"""


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {BOOT}, m AS (SELECT k, b, avg(am) AS s FROM bt GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS r FROM m)
SELECT k, a.a AS alpha, round(s, 4) AS bound FROM o JOIN (SELECT unnest([0.025e0, 0.975e0]) AS a) a ON o.r = round_even(199 * a.a, 0)"""
)
def boot_simple_ci(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.confidence_interval(am, K, "am", samples=200, method="simple"), 4, "bound")


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {BOOT}, m AS (SELECT k, b, max(am) - min(am) AS s FROM bt GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS r FROM m)
SELECT k, a.a AS alpha, round(s, 4) AS bound FROM o JOIN (SELECT unnest([0.025e0, 0.975e0]) AS a) a ON o.r = round_even(199 * a.a, 0)"""
)
def boot_user_ci(spark, sf):
    """A function of the user: the range of the yearly maxima."""
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.confidence_interval(am, K, "am", lambda v: v.max() - v.min(), samples=200, method="simple"), 4, "bound")


@query(f"WITH {DAILY}, {am_cte(14)} SELECT a.k, a.am, round((SELECT max(b.am) - min(b.am) FROM am b WHERE b.k = a.k AND b.year <> a.year), 4) AS left_out FROM am a WHERE a.am IS NOT NULL")
def jackknife_user(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.jackknife(am, K, "am", lambda v: v.max() - v.min()), 4, "left_out")


# The coefficients of Acklam's rational approximation to the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(c: tuple[float, ...], x: str) -> str:
    out = f"{c[0]!r}"
    for v in c[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


def quantile_sql(p: str) -> str:
    q, low, high = f"({p} - 0.5e0)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{_horner(_C, x)} / {_horner(_D, x)}"
    return f"CASE WHEN {p} < 0.02425e0 THEN {tail(low)} WHEN {p} > 0.97575e0 THEN -{tail(high)} ELSE {q} * {_horner(_A, f'({q} * {q})')} / {_horner(_B, f'({q} * {q})')} END"


def cdf_sql(z: str) -> str:
    """The normal distribution function by its series about 0."""
    return f"(0.5e0 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda i: sign({z}) * exp((2 * i + 1) * ln(abs({z}) + 1e-300) - i * ln(2e0) - lgamma(i + 1.5e0) + lgamma(0.5e0) - ln(2e0)))))"


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {BOOT}, m AS (SELECT k, b, avg(am) AS s FROM bt GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS r FROM m),
wh AS (SELECT k, avg(am) AS w, sum(am) AS total, count(*) AS n FROM v GROUP BY 1), jk AS (SELECT v.k, (total - am) / (wh.n - 1) AS j FROM v JOIN wh ON wh.k = v.k), jm AS (SELECT k, avg(j) AS j FROM jk GROUP BY 1),
ac AS (SELECT jk.k, sum(pow(jm.j - jk.j, 3)) / (6 * pow(sum(pow(jm.j - jk.j, 2)), 1.5e0)) AS a FROM jk JOIN jm ON jm.k = jk.k GROUP BY 1),
sh AS (SELECT m.k, avg(CASE WHEN w - s > 1e-12 * abs(w) THEN 1e0 ELSE 0e0 END) AS share FROM m JOIN wh ON wh.k = m.k GROUP BY 1), z0 AS (SELECT k, {quantile_sql('share')} AS z0 FROM sh),
zs AS (SELECT z0.k, q.a AS alpha, z0, ac.a, z0 + {quantile_sql('q.a')} AS z FROM z0 JOIN ac ON ac.k = z0.k CROSS JOIN (SELECT unnest([0.025e0, 0.975e0]) AS a) q),
za AS (SELECT k, alpha, z0 + z / (1 - a * z) AS y FROM zs), sd AS (SELECT k, alpha, {cdf_sql("y")} AS place FROM za)
SELECT sd.k, alpha, round(s, 4) AS bound FROM sd JOIN o ON o.k = sd.k AND o.r = round_even(199 * place, 0)"""
)
def boot_bca_ci(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.confidence_interval(am, K, "am", samples=200, method="bca"), 4, "bound")


@query(f"WITH {DAILY}, {am_cte(14)} SELECT a.k, a.year, round((SELECT avg(b.am) FROM am b WHERE b.k = a.k AND b.year <> a.year), 4) AS left_out FROM am a WHERE a.am IS NOT NULL")
def jackknife_mean(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14).where("am is not null")
    return rounded(E.jackknife_means(am, K, "am").select("k", "year", "left_out"), 4)


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {GUMBEL}, {BOOT},
br AS (SELECT k, b, am AS v, row_number() OVER (PARTITION BY k, b ORDER BY am) - 1 AS i, count(*) OVER (PARTITION BY k, b) AS n FROM bt),
bl AS (SELECT k, b, max(n) AS n, avg(v) AS b0, sum(i * v) / (max(n) * (max(n) - 1)) AS b1, stddev_pop(v) AS sd FROM br GROUP BY 1, 2),
bf AS (SELECT k, b, CASE WHEN n >= 3 AND sd > 0 THEN (2 * b1 - b0) / ln(2e0) END AS sc, CASE WHEN n >= 3 AND sd > 0 THEN b0 - 0.5772156649015329e0 * (2 * b1 - b0) / ln(2e0) END AS lc FROM bl),
bc AS (SELECT bf.k, b, sc + f.scale - avg(sc) OVER (PARTITION BY bf.k) AS sc, lc + f.loc - avg(lc) OVER (PARTITION BY bf.k) AS lc FROM bf JOIN f ON f.k = bf.k),
bq AS (SELECT k, p.T, lc - sc * ln(-ln(1 - 1 / p.T)) AS q FROM bc CROSS JOIN {PERIOD_SQL} p),
bo AS (SELECT *, row_number() OVER (PARTITION BY k, T ORDER BY q NULLS FIRST) - 1 AS r FROM bq)
SELECT k, T AS "T", a.a AS alpha, round(q, 3) AS level FROM bo JOIN (SELECT unnest([0.05e0, 0.95e0]) AS a) a ON bo.r = round_even(199 * a.a, 0)"""
)
def gumbel_ci(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.level_intervals(am, K, PERIODS, "am", samples=200), 3, "level")


@query(
    f"""WITH {DAILY}, {am_cte(14)}, {BOOT}, rp AS (SELECT k, b, am, row_number() OVER (PARTITION BY k, b ORDER BY am) AS i, count(*) OVER (PARTITION BY k, b) AS n FROM bt),
rs AS (SELECT k, b, i, log10(1 / (1 - i / (n + 1e0))) AS p, am, lead(log10(1 / (1 - i / (n + 1e0)))) OVER w AS p1, lead(am) OVER w AS am1 FROM rp WINDOW w AS (PARTITION BY k, b ORDER BY i)),
rt AS (SELECT k, T, am + (log10(T) - p) * (am1 - am) / (p1 - p) AS value FROM rs CROSS JOIN (SELECT unnest([1.5e0, 2.5e0, 5e0]) AS T) WHERE log10(T) >= p AND log10(T) < p1),
rr AS (SELECT *, row_number() OVER (PARTITION BY k, T ORDER BY value) - 1 AS r FROM rt)
SELECT k, T AS "T", a.a AS alpha, round(value, 4) AS value FROM rr JOIN (SELECT unnest([0.05e0, 0.95e0]) AS a) a ON rr.r = round_even(199 * a.a, 0)"""
)
def rps_ci(spark, sf):
    am = S.annual_max(daily(spark, sf), K, min_dist=14)
    return rounded(E.curve_intervals(am, K, [1.5, 2.5, 5], "am", samples=200), 4, "value")
