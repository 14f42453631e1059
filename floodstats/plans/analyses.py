"""Queries over the chained analyses of plans.jobs and plans.commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import arrays
from . import commands, jobs
from .data import CELLS, DAILY, cells, daily, pairs, rounded, table, tree
from .formats import folder
from .network import REACH
from .registry import ORACLES, query
from .series import GUMBEL, am_cte
from .skill import skill_bundle  # noqa: F401  registers the statement that job_validation builds on


def rivers(spark, sf):
    """The daily series as water levels of one scenario and member."""
    return daily(spark, sf).select(F.lit("surge").alias("scen"), F.lit("m").alias("ensemble"), F.col("k").alias("index"), F.col("t").alias("time"), F.col("x").alias("WSE"), (F.col("x") / 2).alias("Q"))


_T = "(SELECT unnest([2e0, 10e0, 100e0]) AS T)"


@query(f'WITH {DAILY}, {am_cte(14)}, {GUMBEL} SELECT \'surge\' AS scen, \'m\' AS ensemble, k AS "index", p.T AS "T", round(loc - scale * ln(-ln(1 - 1 / p.T)), 4) AS level FROM f CROSS JOIN {_T} p')
def job_return_levels(spark, sf):
    return rounded(jobs.extreme_values(rivers(spark, sf), ["surge"], periods=(2, 10, 100), samples=20)["extreme_values"], 4, "level")


@query(f'WITH {DAILY}, {am_cte(14)}, {GUMBEL} SELECT \'surge\' AS scen, \'m\' AS ensemble, k AS "index", round(loc, 4) AS loc, round(scale, 4) AS scale FROM f')
def job_parameters(spark, sf):
    return rounded(jobs.extreme_values(rivers(spark, sf), ["surge"], periods=(2,), samples=20)["params"].select("scen", "ensemble", "index", "loc", "scale"), 4)


@query(f"SELECT 'm' AS ensemble, k AS grdc_id, * EXCLUDE (k) FROM ({ORACLES['skill_bundle']})")
def job_validation(spark, sf):
    p = pairs(spark, sf)
    sim = p.select(F.lit("m").alias("ensemble"), F.col("k").alias("grdc_id"), F.col("t").alias("time"), F.col("sim").alias("outflw"))
    obs = p.select(F.col("k").alias("grdc_id"), F.col("t").alias("time"), F.col("obs").alias("discharge"))
    return rounded(jobs.validation(sim, obs, obs.select("grdc_id").distinct(), min_years=1, shift_days=0)[0])


def _levels(spark, sf):
    """(time, lat, lon, value) of two times."""
    c = cells(spark, sf).withColumn("time", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    return c.select("time", F.col("row").cast("double").alias("lat"), F.col("col").cast("double").alias("lon"), (F.col("value") * F.col("time")).alias("value"))


_LEVELS = f"{CELLS}, g AS (SELECT t.t AS time, row AS lat, col AS lon, value * t.t AS value FROM c CROSS JOIN (SELECT unnest([1e0, 2e0]) AS t) t)"


@query(f"WITH {_LEVELS}, p AS (SELECT s_suppkey AS index, s_suppkey % 47 - 3 + 0.2e0 AS lon, s_suppkey % 9 + 0.3e0 AS lat FROM supplier) SELECT p.index, time, value FROM p JOIN g ON g.lat = round(p.lat) AND g.lon = round(p.lon)")
def job_extract_points(spark, sf):
    k = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select(k.alias("index"), (k % 47 - 3 + 0.2).alias("lon"), (k % 9 + 0.3).alias("lat"))
    return commands.extract_points(_levels(spark, sf), points)


_UNEVEN = f"""{CELLS}, g AS (SELECT zone, row AS lat, col * (col + 1) / 2 AS lon, value FROM c),
xs AS (SELECT DISTINCT lon FROM g), ys AS (SELECT DISTINCT lat FROM g),
p AS (SELECT s_suppkey AS index, s_suppkey * 37 % 900 - 20 + 0.2e0 AS lon, s_suppkey % 9 + 0.3e0 AS lat FROM supplier),
nx AS (SELECT index, arg_min(xs.lon, [abs(xs.lon - p.lon), -xs.lon]) AS lon FROM p, xs WHERE p.lon BETWEEN -0.5e0 AND (SELECT max(lon) FROM xs) + (SELECT max(lon) FROM xs) / 2e0 - (SELECT max(lon) FROM xs WHERE lon < (SELECT max(lon) FROM xs)) / 2e0 GROUP BY 1),
ny AS (SELECT index, arg_min(ys.lat, [abs(ys.lat - p.lat), -ys.lat]) AS lat FROM p, ys WHERE p.lat BETWEEN -0.5e0 AND (SELECT max(lat) FROM ys) + 0.5e0 GROUP BY 1)"""


@query(f"WITH {_UNEVEN} SELECT nx.index, TIMESTAMP '2000-01-01 12:00:00' + to_days(CAST(zone AS INT)) AS time, round(value, 4) AS value FROM nx JOIN ny USING (index) JOIN g ON g.lon = nx.lon AND g.lat = ny.lat", times=("time",))
def job_extract_times(spark, sf):
    """Points on a grid whose longitudes lie ever farther apart, from netCDF files of one time each that count their hours or days."""
    c = cells(spark, sf).select("zone", F.col("row").cast("double").alias("lat"), (F.col("col") * (F.col("col") + 1) / 2).alias("lon"), "value")
    path = folder(spark)
    for odd, unit, step in ((0, "days since 2000-01-01 12:00:00", 1.0), (1, "hours since 2000-01-01", 24.0)):
        own = c.where(F.col("zone") % 2 == odd).withColumn("time", F.col("zone") * step + 12.0 * odd)
        arrays.write_netcdf(own, f"{path}/{odd}", "level", ["time", "lat", "lon"], "zone", coord_attributes={"time": {"units": unit, "calendar": "standard"}})
    k = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select(k.alias("index"), (k * 37 % 900 - 20 + 0.2).alias("lon"), (k % 9 + 0.3).alias("lat"))
    return rounded(commands.extract_points(commands.gridded(spark, f"{path}/*/*.nc", "level", ["time", "lat", "lon"], "time"), points), 4, "value")


@query(f"WITH {_LEVELS} SELECT CASE WHEN lon < 10.5e0 THEN 1 ELSE 2 END :: BIGINT AS index, time, round(sum(value), 4) AS value FROM g WHERE lat BETWEEN -0.5e0 AND 20.5e0 AND lon BETWEEN -0.5e0 AND 30.5e0 GROUP BY 1, 2")
def job_extract_zones(spark, sf):
    box = lambda z, a, b: [(z, a, -0.5, b, -0.5), (z, b, -0.5, b, 20.5), (z, b, 20.5, a, 20.5), (z, a, 20.5, a, -0.5)]
    edges = spark.createDataFrame(box(1, -0.5, 10.5) + box(2, 10.5, 30.5), "index long, x1 double, y1 double, x2 double, y2 double")
    return rounded(commands.extract_zones(_levels(spark, sf), edges, "sum"), 4, "value")


@query(
    f"""{REACH}, o AS (SELECT id, arg_min(anc, step) AS outlet FROM r WHERE anc % 13 = 5 GROUP BY 1),
h AS (SELECT p_partkey AS id, CASE WHEN p_retailprice / 1000 - p_size / 25e0 > 0.01 THEN p_retailprice ELSE 0 END AS hit FROM part) SELECT outlet AS index, 10e0 AS "T", round(sum(hit), 4) AS people_affected FROM o JOIN h ON h.id = o.id GROUP BY 1"""
)
def job_people_affected(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    level = lambda c: p.select("id", F.lit(10.0).alias("T"), c.alias("level"))
    edges = tree(spark, sf)[0]
    mouths = edges.where("id % 13 = 5").select(F.col("id").alias("index"), "id")
    out = jobs.people_affected(level(F.col("p_retailprice") / 1000), level(F.col("p_size") / 25.0), p.select("id", F.col("p_retailprice").alias("people")), edges, mouths)
    return rounded(out, 4, "people_affected")
