"""Orders over long series equal the windows, and no task holds a series of a table with one key."""

import re

import numpy as np
import pytest
from floodstats.operators import climate, extremes, ordered, relational, series, skill
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def long(spark):
    r = np.random.default_rng(2)
    rows = [("a" if i % 20 else "b" if i % 3 else None, i, None if i % 37 == 0 else float(r.integers(0, 400))) for i in range(4000)]
    return spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "k string, t int, x double").repartition(6).cache()


def key(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def lone(df):
    """Whether the plan has an exchange that brings all rows into one task; counts by partition, a row for each, may meet in one."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    ones = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    return any(not re.search(r"Aggregate\(keys?=\[_p", lines[i + 1]) for i in ones)


@pytest.mark.parametrize("keys", [["k"], []])
def test_places(spark, long, keys):
    got = ordered.placed(long, keys, ["t"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.t):
        k = r.k if keys else 0
        assert r._i == seen.get(k, 0)
        seen[k] = r._i + 1
    assert all(r._i_n == seen[r.k if keys else 0] for r in got) and len(got) == 4000


@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
def test_ranks(long, method):
    for keys in (["k"], []):
        assert key(ordered.rank(long, keys, "x", method)) == key(skill.rank(long, keys, "x", method))


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "nearest", "midpoint"])
def test_percentiles(long, method):
    for keys in (["k"], []):
        assert key(ordered.percentile(long, keys, [0, 12.5, 50, 99, 100], "x", method)) == key(skill.percentile(long, keys, [0, 12.5, 50, 99, 100], "x", method))


def test_above_kth(long):
    for k in (1, 100, 3000, 5000):
        assert key(ordered.above_kth(long, "x", k)) == key(skill.above_kth(long, "x", k))


@pytest.mark.parametrize("rows", [40, 333, 10_000])
def test_blocks_with_margins(long, rows):
    for keys in (["k"], []):
        peaks = lambda d, k: series.peaks(d, k, "t", "x", 14)
        assert key(ordered.in_blocks(long, keys, ["t"], peaks, 15, rows)) == key(peaks(long, keys))
        rolled = lambda d, k: series.rolling_max(d, k, 9, "t", "x")
        assert key(ordered.in_blocks(long, keys, ["t"], rolled, 9, rows)) == key(rolled(long, keys))
    with pytest.raises(ValueError):
        ordered.in_blocks(long, [], ["t"], peaks, 15, 15)


def test_times_between_anchors(spark, long):
    """Anchors are far apart, some of no value, so that whole ranges hold none; others hold nothing but anchors."""
    at = lambda df: df.withColumn("t", F.timestamp_seconds(F.col("t") * 60))
    few = long.where("t % 911 = 5 or t between 2000 and 2300")
    for keys in (["k"], []):
        one = few.groupBy(*keys, "t").agg(F.max("x").alias("x"))
        grid = long.where("t % 3 != 1").select(*keys, (F.col("t") * 1.25).cast("int").alias("t"))
        for f in ("interpolate_time", "nearest_time"):
            assert key(getattr(ordered, f)(at(one), at(grid), keys)) == key(getattr(climate, f)(at(one), at(grid), keys)), (f, keys)


def test_carried_by_hand(spark):
    rows = [(i, float(i) if i % 40 == 7 else None) for i in range(300)]
    df = spark.createDataFrame([rows[i] for i in np.random.default_rng(1).permutation(300)], "t int, x double").repartition(3)
    got = {r.t: (r.b, r.a) for r in ordered.carried(df, [], ["t"], {"b": "x"}, {"a": "x"}).collect()}
    full = [i for i in range(300) if i % 40 == 7]
    assert got == {t: (max((v for v in full if v <= t), default=None), min((v for v in full if v >= t), default=None)) for t in range(300)}
    assert not lone(ordered.carried(df, [], ["t"], {"b": "x"}, {"a": "x"}))
    none = df.where("t < 0")
    assert ordered.carried(none, [], ["t"], {"b": "x"}, {}).count() == 0


def test_no_task_holds_the_series(spark, long):
    one = long.drop("k")
    assert lone(series.rolling_max(one, [], 9, "t", "x"))
    assert not lone(ordered.in_blocks(one, [], ["t"], lambda d, k: series.rolling_max(d, k, 9, "t", "x"), 9, 500).where("x > 0"))


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "k string, t int, x double")
    assert ordered.placed(none, ["k"], ["t"]).count() == 0 and ordered.rank(none, ["k"]).count() == 0 and ordered.percentile(none, [], [50]).count() == 0
    nulls = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "k string, t int, x double")
    assert {r.rank for r in ordered.rank(nulls, ["k"]).collect()} == {None} and ordered.above_kth(nulls, "x", 1).count() == 0


def test_statistics_of_the_user(spark):
    r = np.random.default_rng(5)
    rows = [(k, float(v)) for k in ("a", "b") for v in r.gumbel(3, 2, 30)] + [("a", None), ("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    for name, f in (("mean", np.mean), ("median", np.median), ("max", lambda v: v.max()), ("std", np.std)):
        for method in ("simple", "bca"):
            want, got = (sorted((x.k, x.alpha, round(x.bound, 9)) for x in extremes.confidence_interval(df, ["k"], "x", s, samples=60, method=method).collect()) for s in (name, f))
            assert got == want, (name, method)
    left = {(x.k, round(x.x, 9)): x.left_out for x in extremes.jackknife(df, ["k"], "x", lambda v: float(np.ptp(v))).collect()}
    v = np.array([x for k, x in rows if k == "a" and x is not None])
    assert len(left) == 60 and all(left["a", round(x, 9)] == pytest.approx(np.ptp(np.delete(v, i))) for i, x in enumerate(v))
    assert key(extremes.jackknife(df, ["k"], "x", "min")) == key(extremes.jackknife(df, ["k"], "x", lambda v: v.min()))


def test_clashing_coordinates_raise(spark):
    make = lambda rows, c: spark.createDataFrame(rows, f"t int, {c} double")
    same = relational.by_coords([make([(1, 10.0), (2, 5.0)], "a"), make([(1, 10.0), (3, None)], "a"), make([(1, 7.0), (None, 8.0)], "b"), make([(None, 1.0)], "a")], ["t"])
    assert {(r.t, r.a, r.b) for r in same.collect()} == {(1, 10.0, 7.0), (2, 5.0, None), (3, None, None), (None, 1.0, 8.0)}
    with pytest.raises(Exception, match="differ"):
        relational.by_coords([make([(1, 10.0)], "a"), make([(1, 20.0)], "a")], ["t"]).collect()


def test_t_test_without_keys(spark):
    df = spark.createDataFrame([(g, float(v)) for g, a in (("p", 1), ("q", 2), ("r", 9)) for v in (a, a + 1, a + 3)], "g string, x double")
    got = skill.t_test(df, [], "g")
    assert {(r.a, r.b) for r in got.collect()} == {("p", "q"), ("p", "r"), ("q", "r")}
    assert "hint" not in got._jdf.queryExecution().analyzed().toString().lower()
