"""Queries over labelled joins, selections, scalar guards and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import relational as R
from .data import rounded, table
from .registry import query


@query("SELECT coalesce(a.k, b.k) AS k, n, m FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k", whole=("n",))
def outer_merge(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return R.merge([o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("n")), o.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("o_totalprice").alias("m"))], ["k"])


@query("SELECT n_nationkey AS k, n_name, s_acctbal FROM nation JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def inner_align(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("s_acctbal"))
    return R.align(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), s, ["k"])


@query("SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def exact_align(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    r = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), "r_name")
    return R.align_exact(n.drop("n_regionkey"), r, ["k"])


@query("SELECT c_custkey AS k, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey", whole=("n",))
def reindex_like(spark, sf):
    n = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return R.reindex(n, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


LABELS = [7, 3, 3, 21, 0]


@query("SELECT l.i AS ordinal, l.k, n_name FROM (SELECT unnest([7, 3, 3, 21, 0]) AS k, unnest([0, 1, 2, 3, 4]) AS i) l JOIN nation ON n_nationkey = l.k")
def label_list_select(spark, sf):
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(LABELS)], "ordinal int, k int")
    return R.select_labels(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), labels, "k")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'", dates=("t",))
def time_slice(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-03-31").cast("timestamp"))).select("o_orderkey", d.alias("t"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def semi_select(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT n_name, count(c_custkey) AS customers FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def right_join(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000")
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("SELECT 'surge' AS scen, o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 2 UNION ALL SELECT 'tide', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2")
def concat_dim(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return R.concat({"surge": of("O"), "tide": of("F")}, "scen")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def unique_concat(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").where("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def drop_duplicates_last(spark, sf):
    return R.last_of_each(table(spark, sf, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, round(log10(greatest(p_retailprice - 1000, 1e-3)), 6) AS a, round(CASE WHEN p_retailprice - 1000 > 0 THEN log10(p_retailprice - 1000) ELSE 0 END, 6) AS b, round(least(p_retailprice / greatest(CAST(p_size AS DOUBLE), 1) * 100, 9000), 4) AS c, greatest(p_retailprice - 1200, 0) AS d FROM part")
def scalar_guards(spark, sf):
    p = table(spark, sf, "part")
    v = F.col("p_retailprice")
    return p.select("p_partkey", F.round(X.log10_floor(v - 1000, 1e-3), 6).alias("a"), F.round(X.log10_or_zero(v - 1000), 6).alias("b"), F.round(X.percent(v, F.col("p_size").cast("double"), 9000), 4).alias("c"), X.non_negative(v - 1200).alias("d"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS v, CASE WHEN p_size % 5 = 0 THEN -9999 ELSE p_retailprice END AS back FROM part")
def sentinel_clean(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.lit(-9999.0)).when(F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("v"))
    return X.clean(p, ["v"], (-9999.0,)).withColumn("back", F.coalesce("v", F.lit(-9999.0)))


@query("SELECT s_suppkey, CAST(split_part(s_name, '#', 2) AS BIGINT) AS number, printf('run_%06d', s_suppkey) AS name, starts_with(s_name, 'Supplier') :: INT AS ok FROM supplier")
def string_parts(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.element_at(F.split("s_name", "#"), -1).cast("long").alias("number"), F.format_string("run_%06d", "s_suppkey").alias("name"), F.startswith(F.col("s_name"), F.lit("Supplier")).cast("int").alias("ok"))


@query("SELECT p_partkey, round_even(p_retailprice / 100, 0) AS even, CAST(floor(p_retailprice) AS BIGINT) AS low, CASE WHEN p_retailprice < 1200 THEN round((p_retailprice - 900) / 600, 6) ELSE round(0.5 + (p_retailprice - 1200) / 2000, 6) END AS scaled FROM part")
def rounding_and_scaling(spark, sf):
    v = F.col("p_retailprice")
    return table(spark, sf, "part").select("p_partkey", F.bround(v / 100, 0).alias("even"), F.floor(v).alias("low"), F.round(X.normalize_midpoint(v, 900, 1200, 2200), 6).alias("scaled"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def grouped_totals(spark, sf):
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    g = l.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_quantity").alias("quantity"))
    return rounded(rounded(g, 2, "revenue"), 6, "quantity")
