"""Queries over resampling, climatologies and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as T
from ..operators import climate as C
from ..operators import extremes as E
from ..operators import ordered as O
from .data import DAILY, EVENTS, daily, events, rounded, table
from .registry import query

KEY = ["k"]


@query(f"WITH {EVENTS} SELECT k, date_trunc('day', t) AS t, max(x) AS x_max, min(x) AS x_min, round(avg(x), 6) AS x_mean FROM ev GROUP BY 1, 2", times=("t",))
def resample_daily(spark, sf):
    return rounded(C.resample(events(spark, sf), KEY, "day", ["max", "min", "mean"]), 6, "x_mean")


@query(f"WITH {EVENTS} SELECT k, date_trunc('hour', t) AS t, round(sum(x), 6) AS x_sum, count(x) AS x_count FROM ev GROUP BY 1, 2", times=("t",))
def resample_hourly(spark, sf):
    return rounded(C.resample(events(spark, sf), KEY, "hour", ["sum", "count"]))


@query(f"WITH {DAILY}, y AS (SELECT k, year(t) AS y, max(x) AS a, min(x) AS b FROM d GROUP BY 1, 2) SELECT k, round(avg(a), 4) AS x_amax, round(avg(b), 4) AS x_amin FROM y GROUP BY 1")
def resample_annual_two_level(spark, sf):
    return rounded(C.annual_then_mean(daily(spark, sf), KEY, ["max", "min"]), 4)


@query(f"WITH {DAILY} SELECT k, CAST(month(t) AS BIGINT) AS month, round(avg(x), 4) AS clim FROM d GROUP BY 1, 2")
def monthly_climatology(spark, sf):
    return rounded(C.monthly(daily(spark, sf), KEY), 4)


@query(f"WITH {DAILY} SELECT k, CASE WHEN month(t) IN (12, 1, 2) THEN 'DJF' WHEN month(t) <= 5 THEN 'MAM' WHEN month(t) <= 8 THEN 'JJA' ELSE 'SON' END AS season, round(avg(x), 4) AS mean FROM d GROUP BY 1, 2")
def seasonal_mean(spark, sf):
    return rounded(C.seasonal(daily(spark, sf), KEY), 4)


@query(f"WITH {DAILY}, c AS (SELECT k, month(t) AS m, avg(x) AS clim FROM d GROUP BY 1, 2) SELECT d.k, t, x, round(clim, 5) AS clim, round(x - clim, 5) AS anomaly FROM d JOIN c ON c.k = d.k AND c.m = month(d.t)", dates=("t",))
def anomaly_decompose(spark, sf):
    return rounded(C.anomalies(daily(spark, sf), KEY), 5, "clim", "anomaly")


ANCHORS = "mc AS (SELECT k, month(t) AS m, avg(x) AS x FROM d GROUP BY 1, 2), an AS (SELECT k, make_date(1999, CAST(m AS INT), 15) + INTERVAL 0 HOUR AS t, x FROM mc)"


@query(
    f"""WITH {DAILY}, {ANCHORS}, g AS (SELECT DISTINCT k, h.h AS t FROM mc CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '1999-03-31', INTERVAL 6 HOUR)) AS h) h),
s AS (SELECT k, t AS t0, x AS x0, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM an WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT g.k, g.t, round(max(CASE WHEN g.t = t0 THEN x0 ELSE x0 + (epoch(g.t) - epoch(t0)) / (epoch(t1) - epoch(t0)) * (x1 - x0) END), 3) AS x FROM g LEFT JOIN s ON s.k = g.k AND g.t >= t0 AND g.t < t1 GROUP BY 1, 2""",
    times=("t",),
)
def clim_interp_linear(spark, sf):
    m = C.monthly(daily(spark, sf), KEY)
    anchors = m.select("k", F.make_timestamp(F.lit(1999), F.col("month").cast("int"), F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("t"), F.col("clim").alias("x"))
    grid = m.select("k").distinct().withColumn("t", F.explode(T.dates(F.to_timestamp(F.lit("1999-01-01")), F.to_timestamp(F.lit("1999-03-31")), "6 hours")))
    return rounded(C.interpolate_time(anchors, grid, KEY), 3)


@query(
    f"""WITH {EVENTS}, g AS (SELECT k.k, h.h AS t FROM (SELECT DISTINCT k FROM ev) k CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-08', INTERVAL 30 MINUTE)) AS h) h),
b AS (SELECT g.k, g.t, ev.t AS t0, ev.x AS x0 FROM g ASOF LEFT JOIN ev ON ev.k = g.k AND g.t >= ev.t), a AS (SELECT g.k, g.t, ev.t AS t1, ev.x AS x1 FROM g ASOF LEFT JOIN ev ON ev.k = g.k AND g.t <= ev.t)
SELECT b.k, b.t, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR b.t - t0 <= t1 - b.t) THEN x0 ELSE x1 END AS x FROM b JOIN a ON a.k = b.k AND a.t = b.t""",
    times=("t",),
)
def nearest_time_sample(spark, sf):
    instants = spark.range(1).select(F.explode(T.dates(F.to_timestamp(F.lit("2024-01-02")), F.to_timestamp(F.lit("2024-01-08")), "30 minutes")).alias("t"))
    return C.nearest_time_union(events(spark, sf), instants, KEY)


#: All events as one series, which no task holds (`operators.ordered`): purchases are the anchors, the other events' times the grid.
_SIDES = f"""{EVENTS}, a AS (SELECT t, x FROM ev WHERE k = 'purchase' AND x IS NOT NULL), g AS (SELECT DISTINCT t FROM ev WHERE k <> 'purchase'),
s AS (SELECT g.t, b.t AS t0, b.x AS x0 FROM g ASOF LEFT JOIN a b ON g.t >= b.t), e AS (SELECT s.*, c.t AS t1, c.x AS x1 FROM s ASOF LEFT JOIN a c ON s.t < c.t)"""


def _sides(spark, sf):
    ev = events(spark, sf)
    return ev.where("k = 'purchase'").select("t", "x"), ev.where("k <> 'purchase'").select("t").distinct()


@query(f"WITH {_SIDES} SELECT t, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN x0 ELSE x1 END AS x FROM e", times=("t",))
def long_nearest_time(spark, sf):
    return O.nearest_time(*_sides(spark, sf), [])


@query(f"WITH {_SIDES} SELECT t, round(CASE WHEN t = t0 THEN x0 ELSE x0 + CAST(epoch_us(t) - epoch_us(t0) AS DOUBLE) / (epoch_us(t1) - epoch_us(t0)) * (x1 - x0) END, 3) AS x FROM e", times=("t",))
def long_interpolation(spark, sf):
    return rounded(O.interpolate_time(*_sides(spark, sf), []), 3)


@query("SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS t", dates=("t",))
def date_range_months(spark, sf):
    return spark.range(1).select(F.explode(T.dates(F.lit("2000-01-01").cast("date"), F.lit("2000-12-01").cast("date"), "1 month")).alias("t"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year, date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)) AS days FROM orders")
def days_in_years(spark, sf):
    t = F.col("o_orderdate")
    return table(spark, sf, "orders").select(T.year(t).alias("year"), T.days_in_year(t).alias("days")).distinct()


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders", dates=("t",))
def year_day_parse(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.from_year_day(F.date_format("o_orderdate", "yyyyDDD")).alias("t"))


@query(
    """WITH l AS (SELECT l_returnflag AS k, t.T AS T, round(avg(l_extendedprice) * ln(1 + t.T), 3) AS v FROM lineitem CROSS JOIN (SELECT unnest([2e0, 5e0, 10e0, 50e0, 100e0]) AS T) t GROUP BY 1, 2),
p AS (SELECT k, 1 / T AS p, v FROM l UNION ALL SELECT DISTINCT k, 1e0, 0e0 FROM l), a AS (SELECT k, (lead(p) OVER w - p) * (lead(v) OVER w + v) / 2 AS a FROM p WINDOW w AS (PARTITION BY k ORDER BY p))
SELECT k, round(sum(a), 3) AS expected FROM a GROUP BY 1"""
)
def trapz_expected_annual(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.avg("l_extendedprice").alias("a"))
    v = E.values(l, "T", [2, 5, 10, 50, 100]).withColumn("x", F.round(F.col("a") * F.log(1 + F.col("T")), 3))
    return rounded(C.expected_annual(v, KEY), 3)
