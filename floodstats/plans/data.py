"""Test tables seen as the series, pairs, members, points, cells and networks that the operators work on; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """The double columns (or those named) rounded, so that two engines' sums agree."""
    own = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in own})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, x): each order priority's total by day, 0 where none."""
    o = table(spark, sf_dir, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    return densify(d, ["k"], "t", {"x": 0.0})


DAILY = """cal AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS t FROM orders),
ks AS (SELECT DISTINCT o_orderpriority AS k FROM orders),
raw AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS t, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2),
d AS (SELECT ks.k, cal.t, coalesce(raw.x, 0e0) AS x FROM ks CROSS JOIN cal LEFT JOIN raw ON raw.k = ks.k AND raw.t = cal.t)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, sim, obs): daily orders against daily shipments, with holes in both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("k"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("t"), "l_extendedprice")
    y = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("k", "t").agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    d = daily(spark, sf_dir).join(y, ["k", "t"], "left")
    return d.select("k", "t", F.when(F.dayofmonth("t") != 13, F.col("x")).alias("sim"), F.when(F.dayofyear("t") % 17 != 0, F.coalesce("y", F.lit(0.0))).alias("obs"))


PAIRS = (
    DAILY
    + """,
sh AS (SELECT o_orderpriority AS k, CAST(l_shipdate AS DATE) AS t, round(sum(l_extendedprice), 2) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT d.k, d.t, CASE WHEN day(d.t) <> 13 THEN d.x END AS sim, CASE WHEN dayofyear(d.t) % 17 <> 0 THEN coalesce(sh.y, 0e0) END AS obs FROM d LEFT JOIN sh ON sh.k = d.k AND sh.t = d.t)"""
)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, s, k, v, lo, hi): a mean with bounds for each member (order status), scenario (return flag) and key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("m"), F.col("o_orderpriority").alias("k"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("s"), "l_extendedprice")
    g = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("m", "s", "k").agg(F.round(F.avg("l_extendedprice"), 3).alias("v"), F.round(F.stddev_pop("l_extendedprice") / F.sqrt(F.count("*")), 3).alias("e"))
    return g.select("m", "s", "k", "v", F.round(F.col("v") - F.col("e") * 0.1, 3).alias("lo"), F.round(F.col("v") + F.col("e") * 0.1, 3).alias("hi"))


MEMBERS = """g AS (SELECT o_orderstatus AS m, l_returnflag AS s, o_orderpriority AS k, round(avg(l_extendedprice), 3) AS v, round(stddev_pop(l_extendedprice) / sqrt(count(*)), 3) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
e AS (SELECT m, s, k, v, round(v - e * 1e-1, 3) AS lo, round(v + e * 1e-1, 3) AS hi FROM g)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, x): one row for each event type and time (microseconds)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("t")).agg(F.max("value").alias("x"))


EVENTS = "ev AS (SELECT event_type AS k, CAST(ts AS TIMESTAMP) AS t, max(value) AS x FROM events GROUP BY 1, 2)"


def places(spark: SparkSession, sf_dir: str, name: str, key: str, shift: int) -> DataFrame:
    """(id, lon, lat) from integer keys."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * 37 + shift) % 360 - 180 + (k % 7) * 0.1).alias("lon"), ((k * 17 + shift) % 150 - 75 + (k % 11) * 0.1).alias("lat"))


def places_sql(name: str, key: str, shift: int) -> str:
    return f"(SELECT {key} AS id, ({key} * 37 + {shift}) % 360 - 180 + ({key} % 7) * 1e-1 AS lon, ({key} * 17 + {shift}) % 150 - 75 + ({key} % 11) * 1e-1 AS lat FROM {name})"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value, zone, size) of the parts, 40 columns wide."""
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 40).cast("int").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 6).cast("long").alias("zone"), F.col("p_size").cast("long").alias("size"))


CELLS = "c AS (SELECT CAST(p_partkey // 40 AS INT) AS row, CAST(p_partkey % 40 AS INT) AS col, p_retailprice AS value, CAST(p_size % 6 AS BIGINT) AS zone, CAST(p_size AS BIGINT) AS size FROM part)"


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (id, next_id) of a binary tree over the parts, and (id, state)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("next_id")), p.select(k.alias("id"), F.col("p_size").cast("long").alias("state"))


TREE = "n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS next_id, CAST(p_size AS BIGINT) AS state FROM part)"
