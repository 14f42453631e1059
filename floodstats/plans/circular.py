"""Queries over circular statistics and flood timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import circular as C
from ..operators import skill as K
from .data import DAILY, PAIRS, daily, pairs, rounded, table
from .registry import query
from .series import peak_cte

KEY = ["k"]
DAYS = "date_diff('day', make_date({0}, 1, 1), make_date({0} + 1, 1, 1))"


def angle(doy: str, year: str) -> str:
    a = f"({doy} * 2 * pi() / {DAYS.format(year)})"
    return f"CASE WHEN {a} > pi() THEN {a} - 2 * pi() ELSE {a} END"


ANGLES = f"a AS (SELECT o_orderpriority AS k, o_orderkey AS id, {angle('dayofyear(o_orderdate)', 'year(o_orderdate)')} AS th, {angle('dayofyear(o_orderdate + INTERVAL 40 DAY)', 'year(o_orderdate + INTERVAL 40 DAY)')} AS ph FROM orders WHERE o_orderkey % 11 <> 0)"


def angles(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 11 <> 0").withColumns({"d": F.col("o_orderdate").cast("date"), "e": F.date_add(F.col("o_orderdate").cast("date"), 40)})
    of = lambda c: C.doy_to_angle(F.dayofyear(c), F.year(c))
    return o.select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"), of("d").alias("th"), of("e").alias("ph"))


@query(f"WITH {ANGLES} SELECT id, round(th, 6) AS th FROM a")
def doy_to_circ(spark, sf):
    return rounded(angles(spark, sf).select("id", "th"))


@query(f"WITH {ANGLES}, b AS (SELECT id, CASE WHEN th < 0 THEN th + 2 * pi() ELSE th END * 365 / (2 * pi()) AS d FROM a) SELECT id, round(CASE WHEN d < 1 THEN 365 ELSE d END, 4) AS doy FROM b")
def circ_to_doy(spark, sf):
    return rounded(angles(spark, sf).select("id", C.angle_to_doy(F.col("th")).alias("doy")), 4)


@query(f"WITH {ANGLES} SELECT k, round(atan2(avg(sin(th)), avg(cos(th))), 6) AS mean FROM a GROUP BY 1")
def circ_mean(spark, sf):
    return rounded(angles(spark, sf).groupBy("k").agg(C.mean(F.col("th")).alias("mean")))


@query(f"WITH {ANGLES} SELECT k, round(1 - sqrt(pow(avg(sin(th)), 2) + pow(avg(cos(th)), 2)), 6) AS var FROM a GROUP BY 1")
def circ_var(spark, sf):
    return rounded(angles(spark, sf).groupBy("k").agg(C.variance(F.col("th")).alias("var")))


@query(f"WITH {ANGLES}, m AS (SELECT k, sum((id % 5) * cos(2 * (th - 0.5e0))) / sum(id % 5) AS c, sum((id % 5) * sin(2 * (th - 0.5e0))) / sum(id % 5) AS s FROM a GROUP BY 1) SELECT k, round(atan2(s, c), 6) AS angle, round(sqrt(c * c + s * s), 6) AS length FROM m")
def circ_moment_p2(spark, sf):
    x, w = F.col("th"), F.col("id") % 5
    return rounded(angles(spark, sf).groupBy("k").agg(C.mean(x, 2, 0.5, w).alias("angle"), C.length(x, 2, 0.5, w).alias("length")))


@query(f"WITH {ANGLES}, m AS (SELECT k, atan2(sum(sin(th)), sum(cos(th))) AS ma, atan2(sum(sin(ph)), sum(cos(ph))) AS mb FROM a GROUP BY 1) SELECT k, round(sum(sin(th - ma) * sin(ph - mb)) / sqrt(sum(pow(sin(th - ma), 2)) * sum(pow(sin(ph - mb), 2))), 6) AS r FROM a JOIN m USING (k) GROUP BY 1")
def circ_corr(spark, sf):
    return rounded(C.correlation(angles(spark, sf), KEY, "th", "ph"))


RAYLEIGH = "exp(-z) * CASE WHEN n < 50 THEN 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * pow(z, 3) - 9 * pow(z, 4)) / (288 * n * n) ELSE 1 END"


@query(f"WITH {ANGLES}, g AS (SELECT k, id % 300 AS part, th FROM a), m AS (SELECT k, part, count(*) * 1e0 AS n, (pow(avg(sin(th)), 2) + pow(avg(cos(th)), 2)) * count(*) AS z FROM g GROUP BY 1, 2) SELECT k, part, round({RAYLEIGH}, 6) AS p FROM m")
def rayleigh_p(spark, sf):
    a = angles(spark, sf).withColumn("part", F.col("id") % 300)
    return rounded(a.groupBy("k", "part").agg(C.rayleigh(F.col("th")).alias("p")))


@query(f"WITH {ANGLES}, m AS (SELECT id, ph - th AS d FROM a) SELECT id, round(CASE WHEN abs(d) >= pi() THEN 2 * pi() - abs(d) ELSE d END, 6) AS diff, round(atan2(sin(d), cos(d)), 6) AS signed FROM m")
def angle_diff(spark, sf):
    a, b = F.col("th"), F.col("ph")
    return rounded(angles(spark, sf).select("id", C.angle_diff(a, b).alias("diff"), C.angle_diff_signed(a, b).alias("signed")))


def flood_sql(source: str, x: str, d: int, name: str) -> str:
    """CTEs of yearly greatest peaks and their first day, from column x of source."""
    return f"""{name}0 AS (SELECT k, t, CASE WHEN {x} > lag({x}) OVER w AND lead({x}) OVER w <= {x} THEN {x} END AS c FROM {source} WINDOW w AS (PARTITION BY k ORDER BY t)),
{name}1 AS (SELECT k, t, {"c" if d == 1 else f"CASE WHEN c = max(c) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {d} PRECEDING AND {d - 1} FOLLOWING) THEN c END"} AS pk FROM {name}0),
{name} AS (SELECT k, CAST(year(t) AS BIGINT) AS year, max(pk) AS annual_max, CAST(arg_max(dayofyear(t), (pk, -dayofyear(t))) FILTER (pk IS NOT NULL) AS BIGINT) AS doy FROM {name}1 GROUP BY 1, 2)"""


FD = flood_sql("d", "x", 30, "fd")
TIMING = f"fa AS (SELECT k, {angle('doy', 'CAST(year AS INT)')} AS th FROM fd WHERE doy IS NOT NULL), fm AS (SELECT k, atan2(avg(sin(th)), avg(cos(th))) AS mean, sqrt(pow(avg(sin(th)), 2) + pow(avg(cos(th)), 2)) AS len, count(*) * 1e0 AS n, (pow(avg(sin(th)), 2) + pow(avg(cos(th)), 2)) * count(*) AS z FROM fa GROUP BY 1), fs AS (SELECT *, CASE WHEN mean < 0 THEN mean + 2 * pi() ELSE mean END * 365 / (2 * pi()) AS dm FROM fm)"


@query(f"WITH {DAILY}, {FD} SELECT * FROM fd")
def flood_day(spark, sf):
    return C.flood_days(daily(spark, sf), KEY, min_dist=30)


@query(f"WITH {DAILY}, {FD}, {TIMING} SELECT k, round(CASE WHEN dm < 1 THEN 365 ELSE dm END, 6) AS doy_mean, round(1 - len, 6) AS doy_var, round({RAYLEIGH}, 6) AS doy_uniform_p FROM fs")
def mean_flood_day(spark, sf):
    return rounded(C.mean_flood_day(C.flood_days(daily(spark, sf), KEY, min_dist=30), KEY))


@query(f"WITH {DAILY}, {FD}, {TIMING} SELECT k, year, annual_max, doy, round(CASE WHEN dm < 1 THEN 365 ELSE dm END, 6) AS doy_mean, round(1 - len, 6) AS doy_var, round({RAYLEIGH}, 6) AS doy_uniform_p FROM fs JOIN fd USING (k)")
def mean_flood_day_stats(spark, sf):
    return rounded(C.flood_day_stats(daily(spark, sf), KEY, min_dist=30))


BOTH = f"""{flood_sql("p", "sim", 30, "fs")}, {flood_sql("p", "obs", 30, "fo")},
bo AS (SELECT coalesce(fs.k, fo.k) AS k, fs.annual_max AS s, fo.annual_max AS o, {angle("fs.doy", "CAST(fs.year AS INT)")} AS ts, {angle("fo.doy", "CAST(fo.year AS INT)")} AS tn FROM fs FULL JOIN fo ON fs.k = fo.k AND fs.year = fo.year),
bm AS (SELECT k, atan2(avg(sin(ts)), avg(cos(ts))) AS ms, atan2(avg(sin(tn)), avg(cos(tn))) AS mo, avg(sin(tn)) AS so, avg(cos(tn)) AS co, count(tn) * 1e0 AS n, sum(s - o) / sum(o) AS bias FROM bo GROUP BY 1)"""
DIFF = "(CASE WHEN abs(ms - mo) >= pi() THEN 2 * pi() - abs(ms - mo) ELSE ms - mo END) * 365 / (2 * pi())"
CORR = "cm AS (SELECT k, atan2(sum(sin(ts)), sum(cos(ts))) AS a, atan2(sum(sin(tn)), sum(cos(tn))) AS b FROM bo WHERE ts IS NOT NULL AND tn IS NOT NULL GROUP BY 1), cr AS (SELECT k, sum(sin(tn - b) * sin(ts - a)) / sqrt(sum(pow(sin(tn - b), 2)) * sum(pow(sin(ts - a), 2))) AS r FROM bo JOIN cm USING (k) WHERE ts IS NOT NULL AND tn IS NOT NULL GROUP BY 1)"


def _both(spark, sf):
    p = pairs(spark, sf)
    side = lambda c, n: C.flood_days(p.select("k", "t", F.col(c).alias("x")), KEY, min_dist=30).select("k", "year", C.doy_to_angle(F.col("doy"), F.col("year")).alias(n))
    return side("sim", "ts").join(side("obs", "tn"), ["k", "year"], "full")


@query(f"WITH {PAIRS}, {BOTH} SELECT k, round({DIFF}, 6) AS diff FROM bm")
def mean_flood_day_diff(spark, sf):
    d = C.angle_diff(C.mean(F.col("tn")), C.mean(F.col("ts"))) * 365 / (2 * C.PI)
    return rounded(_both(spark, sf).groupBy("k").agg(d.alias("diff")))


@query(f"WITH {PAIRS}, {BOTH}, {CORR} SELECT k, round(r, 6) AS r FROM cr")
def corr_flood_day(spark, sf):
    return rounded(C.correlation(_both(spark, sf), KEY, "ts", "tn"))


@query(
    f"""WITH {PAIRS}, {BOTH}, {CORR}, rr AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2e0 AS a, rank() OVER (PARTITION BY k ORDER BY o) + (count(*) OVER (PARTITION BY k, o) - 1) / 2e0 AS b FROM bo WHERE s IS NOT NULL AND o IS NOT NULL),
rc AS (SELECT k, corr(a, b) AS am_rank_corr FROM rr GROUP BY 1), z AS (SELECT *, (so * so + co * co) * n AS z FROM bm)
SELECT z.k, round(bias, 6) AS am_bias, round({DIFF}, 6) AS am_doy_diff, round({RAYLEIGH}, 6) AS doy_uniform_p, round(1 - sqrt(so * so + co * co), 6) AS doy_var, round(am_rank_corr, 6) AS am_rank_corr, round(cr.r, 6) AS am_doy_corr FROM z JOIN rc USING (k) JOIN cr USING (k)"""
)
def skill_annual_max_bundle(spark, sf):
    return rounded(K.annual_max_metrics(pairs(spark, sf), KEY))
