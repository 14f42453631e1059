"""Queries over ensembles and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as N
from .data import MEMBERS, members, rounded, table
from .registry import query


@query(f"WITH {MEMBERS} SELECT s, k, m, v FROM e UNION ALL SELECT s, k, 'mean', round(avg(v), 3) FROM e GROUP BY 1, 2")
def ensemble_mean_append(spark, sf):
    return rounded(N.append_mean(members(spark, sf).select("s", "k", "m", "v"), ["s", "k"], "m", ["v"]), 3)


FLAGS = "fl AS (SELECT m, k, bool_or(s = 'A' AND v > 38300) AS h, bool_or(s = 'N' AND v > 38300) AS q FROM e GROUP BY 1, 2)"


def flags(spark, sf):
    at = lambda s: F.bool_or((F.col("s") == s) & (F.col("v") > 38300))
    return members(spark, sf).groupBy("m", "k").agg(at("A").alias("h"), at("N").alias("q"))


VOTE = "vo AS (SELECT k, sum(CAST(h AS INT)) >= ceil(count(DISTINCT m) / 2e0) AS h, sum(CAST(q AS INT)) >= ceil(count(DISTINCT m) / 2e0) AS q FROM fl GROUP BY 1)"


@query(f"WITH {MEMBERS}, {FLAGS}, {VOTE} SELECT k, CAST(h AS INT) AS h, CAST(q AS INT) AS q FROM vo")
def majority_vote(spark, sf):
    return N.majority(flags(spark, sf), ["k"], "m", ["h", "q"]).select("k", F.col("h").cast("int").alias("h"), F.col("q").cast("int").alias("q"))


@query(f"WITH {MEMBERS}, {FLAGS}, {VOTE} SELECT k, CAST(CASE WHEN h AND q THEN 3 WHEN h THEN 1 WHEN q THEN 2 ELSE 4 END AS BIGINT) AS class FROM vo")
def dominant_driver_class(spark, sf):
    return N.driver_class(N.majority(flags(spark, sf), ["k"], "m", ["h", "q"])).select("k", "class")


DIFF = "df AS (SELECT a.m, a.k, a.v - b.v AS diff FROM e a JOIN e b ON a.m = b.m AND a.k = b.k WHERE a.s = 'A' AND b.s = 'N')"


@query(f"WITH {MEMBERS}, {DIFF} SELECT m, k, round(diff, 3) AS diff FROM df")
def scenario_diff(spark, sf):
    return rounded(N.difference(members(spark, sf), ["m", "k"], "s", "A", "N", "v"), 3)


@query(f"WITH {MEMBERS}, {DIFF} SELECT k, CAST(abs(sum(sign(diff))) = count(*) AS INT) AS agree FROM df GROUP BY 1")
def direction_agreement(spark, sf):
    d = N.difference(members(spark, sf), ["m", "k"], "s", "A", "N", "v")
    return N.agreement(d, ["k"], "diff").withColumn("agree", F.col("agree").cast("int"))


@query(f"WITH {MEMBERS} SELECT a.k, CAST(bool_and(a.lo > b.hi OR b.lo > a.hi) AS INT) AS significant FROM e a JOIN e b ON a.m = b.m AND a.k = b.k WHERE a.s = 'A' AND b.s = 'N' GROUP BY 1")
def ci_separation_sig(spark, sf):
    return N.separated(members(spark, sf), ["k"], "m", "s", "A", "N", "lo", "hi").withColumn("significant", F.col("significant").cast("int"))


@query(f"WITH {MEMBERS}, {DIFF}, c AS (SELECT m, CASE WHEN diff > 200 THEN 1 WHEN diff < -200 THEN 2 ELSE 0 END AS code FROM df) SELECT m, CAST(code AS BIGINT) AS code, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY m), 4) AS share FROM c GROUP BY 1, 2")
def diff_class_share(spark, sf):
    d = N.difference(members(spark, sf), ["m", "k"], "s", "A", "N", "v")
    code = F.when(F.col("diff") > 200, 1).when(F.col("diff") < -200, 2).otherwise(0).cast("long")
    return rounded(N.shares(d.withColumn("code", code), ["m"], "code"), 4)


@query(f"WITH {MEMBERS} SELECT k, s, max(CASE WHEN m = 'F' THEN v END) AS \"F\", max(CASE WHEN m = 'O' THEN v END) AS \"O\", max(CASE WHEN m = 'P' THEN v END) AS \"P\" FROM e GROUP BY 1, 2")
def pivot_models(spark, sf):
    return rounded(N.wide(members(spark, sf), ["k", "s"], "m", ["F", "O", "P"], "v"), 3)


@query(f"WITH {MEMBERS} SELECT m, s, k, 'lo' AS bound, lo AS x FROM e UNION ALL SELECT m, s, k, 'hi', hi FROM e")
def unpivot_bounds(spark, sf):
    return N.long(members(spark, sf), ["m", "s", "k"], ["lo", "hi"], "bound", "x")


@query(f"WITH {MEMBERS} SELECT m, round(sum(CASE WHEN s = 'A' AND v > 38000 THEN v END), 2) AS above, round(sum(CASE WHEN s = 'N' THEN v END), 2) AS base FROM e GROUP BY 1")
def impact_totals(spark, sf):
    e = members(spark, sf)
    return rounded(e.groupBy("m").agg(F.sum(F.when((F.col("s") == "A") & (F.col("v") > 38000), F.col("v"))).alias("above"), F.sum(F.when(F.col("s") == "N", F.col("v"))).alias("base")), 2)


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'surge' WHEN 'N' THEN 'seas' ELSE 'tide' END AS scen, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) :: BIGINT AS quantity FROM lineitem GROUP BY 1")
def scenario_rename(spark, sf):
    name = F.create_map(*[F.lit(x) for p in (("A", "surge"), ("N", "seas"), ("R", "tide")) for x in p])
    return table(spark, sf, "lineitem").groupBy(F.element_at(name, F.col("l_returnflag")).alias("scen")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
