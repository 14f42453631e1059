"""Operators against answers worked out by hand or by plain numpy."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from floodstats.functions import scalar as X
from floodstats.functions.special import beta_regularized
from floodstats.operators import circular as C
from floodstats.operators import climate as L
from floodstats.operators import extremes as E
from floodstats.operators import network as N
from floodstats.operators import relational as R
from floodstats.operators import series as S
from floodstats.operators import skill as K
from floodstats.operators import spatial as G
from pyspark.sql import functions as F


def series(spark, values, start=date(2000, 1, 1)):
    rows = [("a", start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t date, x double")


def peak_places(spark, values, d):
    rows = S.peaks(series(spark, values), ["k"], min_dist=d).where("peak is not null").collect()
    return {(r.t - date(2000, 1, 1)).days: r.peak for r in rows}


@pytest.mark.parametrize(
    "values, d, want",
    [
        ([1, 3, 2, 2, 5, 5, 1, 4], 1, {1: 3, 4: 5}),
        ([1, 3, 2, 2, 5, 5, 1, 4], 3, {1: 3, 4: 5}),
        ([1, 3, 2, 2, 5, 5, 1, 4], 4, {4: 5}),
        ([1, 2, 2, 3, 1], 1, {1: 2, 3: 3}),
        ([0, 5, 0, 0, 0, 3, 0], 4, {1: 5}),
        ([0, 3, 0, 0, 0, 5, 0], 4, {1: 3, 5: 5}),
        ([5], 1, {}),
        ([], 1, {}),
    ],
)
def test_peaks(spark, values, d, want):
    assert peak_places(spark, values, d) == want


def test_gumbel_and_pareto(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5]] + [("p", float(v)) for v in [1, 2, 3, 4, 10]] + [("flat", 7.0)] * 4 + [("few", 1.0), ("few", 4.0)] + [("none", None)], "k string, x double")
    fits = {r.k: r for r in E.fit(df, ["k"]).collect()}
    assert fits["g"]["loc"] == pytest.approx(2.1672538227) and fits["g"].scale == pytest.approx(1.4426950409)
    assert fits["flat"].scale is None and fits["few"].scale is None and "none" not in fits
    levels = {(r.k, r["T"]): r.level for r in E.return_levels(df, ["k"], [2, 10, 100]).collect()}
    assert [levels["g", t] for t in (2, 10, 100)] == pytest.approx([2.6960201957, 5.4138476060, 8.8038662995])
    assert levels["flat", 10] == 7 and levels["few", 2] == 2.5
    p = E.fit(df, ["k"], dist="gpa").where("k = 'p'").first()
    assert (p["shape"], p["loc"], p.scale) == pytest.approx((-1 / 3, 2 / 3, 20 / 9))
    levels = {r["T"]: r.level for r in E.return_levels(df, ["k"], [2, 10, 100], dist="gpa").where("k = 'p'").collect()}
    assert [levels[t] for t in (2, 10, 100)] == pytest.approx([2.3994736660, 8.3628979335, 24.9439255574])


def test_plotting_positions(spark):
    df = series(spark, [10, 30, 20, None])
    got = {r.x: r.period for r in E.plotting_positions(df, ["k"], order=["t"]).collect()}
    assert [got[v] for v in (10, 30, 20)] == pytest.approx([4 / 3, 4, 2]) and got[None] is None
    got = {r.x: r.period for r in E.plotting_positions(df, ["k"], n_years=2).collect()}
    assert [got[v] for v in (10, 30, 20)] == pytest.approx([0.8888888889, 2.6666666667, 1.3333333333])


def test_scores(spark):
    df = spark.createDataFrame([("a", float(s), float(o)) for s, o in zip([1, 2, 3], [2, 4, 6])] + [("a", None, None)], "k string, sim double, obs double")
    s, o = F.col("sim"), F.col("obs")
    r = df.groupBy("k").agg(K.bias(s, o).alias("b"), K.percent_bias(s, o).alias("p"), K.nash_sutcliffe(s, o).alias("n"), K.sse(s, o).alias("e"), *[c.alias(n) for n, c in K.kling_gupta(s, o).items()]).first()
    assert (r.b, r.p, r.n, r.e) == (-2, -0.5, -0.75, 14) and (r.kge_rel_var, r.kge_bias) == (0.5, 0.5) and r.kge == pytest.approx(0.2928932188)
    same = df.groupBy("k").agg(K.kling_gupta(o, o)["kge"].alias("kge"), K.nash_sutcliffe(o, o).alias("n")).first()
    assert same.kge == pytest.approx(1) and same.n == 1


def test_circular(spark):
    df = spark.createDataFrame([(0.0,), (math.pi / 2,), (None,)], "a double")
    a = F.col("a")
    r = df.agg(C.mean(a).alias("m"), C.variance(a).alias("v"), C.rayleigh(a).alias("p")).first()
    assert (r.m, r.v, r.p) == pytest.approx((0.7853981634, 0.2928932188, 0.4269573028))
    d = lambda x, y: spark.range(1).select(C.angle_diff(F.lit(x), F.lit(y))).first()[0]
    assert (d(-3.0, 3.0), d(3.0, -3.0), d(1.0, 0.5)) == pytest.approx((0.2831853072, 0.2831853072, -0.5))
    c = lambda doy, y: spark.range(1).select(C.doy_to_angle(F.lit(doy), F.lit(y))).first()[0]
    assert (c(1, 2001), c(200, 2001), c(366, 2000)) == pytest.approx((0.0172142063, -2.8403440430, 0), abs=1e-9)


def test_expected_annual(spark):
    df = spark.createDataFrame([("a", 2.0, 100.0), ("a", 10.0, 200.0)], "k string, T double, x double")
    assert L.expected_annual(df, ["k"]).first().expected == pytest.approx(85)


def test_spheres(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(X.sphere_distance(*lit(0, 0, 1, 0)).alias("a"), X.sphere_distance(*lit(0, 60, 1, 60)).alias("b"), X.sphere_distance(*lit(3.3, 51.7, 3.3, 51.7)).alias("c"), X.cell_area(F.lit(0.125), 0.25, 0.25).alias("d")).first()
    assert r.a == pytest.approx(111229.833, abs=1e-3) and r.b == pytest.approx(55614.387, abs=1e-3) and r.c == pytest.approx(0, abs=0.2) and r.d == pytest.approx(772767029.897, abs=0.01)


def test_accumulation_and_cycle(spark):
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 1)], "id long, next_id long")
    state = edges.select("id", (F.col("id") + 1).alias("state"))
    assert {r.id: r.state for r in N.accumulate(edges, state).collect()} == {0: 15, 1: 11, 2: 3, 3: 4, 4: 5}
    ring = spark.createDataFrame([(0, 1), (1, 0)], "id long, next_id long")
    with pytest.raises(ValueError):
        N.accumulate(ring, ring.select("id", F.lit(1).alias("state")))
    with pytest.raises(ValueError):
        N.basins(ring)


def test_deep_network(spark):
    r = np.random.default_rng(3)
    nxt = [None, *(int(max(0, i - r.integers(1, 4))) for i in range(1, 400))]
    edges = spark.createDataFrame(list(enumerate(nxt)), "id long, next_id long")
    want = np.ones(400, int)
    for i in range(399, 0, -1):
        want[nxt[i]] += want[i]
    got = N.accumulate(edges, edges.select("id", F.lit(1).alias("state"))).collect()
    assert {x.id: x.state for x in got} == dict(enumerate(want.tolist()))
    assert {x.basin for x in N.basins(edges).collect()} == {0}


def test_mass_is_kept(spark):
    edges = spark.createDataFrame([(i, None if i == 0 else (i - 1) // 3) for i in range(200)], "id long, next_id long")
    state = edges.select("id", (F.col("id") * 2 + 1).alias("state"))
    assert N.flux(edges, state).agg(F.sum("state")).first()[0] == state.agg(F.sum("state")).first()[0]


def test_t_distribution():
    # Closed forms for one and two degrees of freedom.
    for t in (0.1, 0.7, 2.0, 15.0):
        one, two = 1 - 2 / math.pi * math.atan(t), 1 - t / math.sqrt(2 + t * t)
        got = beta_regularized(np.array([0.5, 1.0]), 0.5, np.array([1 / (1 + t * t), 2 / (2 + t * t)]))
        assert got == pytest.approx([one, two], rel=1e-9)


def test_percentiles_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=57).round(3)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("b", None)], "k string, x double")
    for method in ("linear", "lower", "higher", "nearest", "midpoint"):
        got = {r.q: r.value for r in K.percentile(df, ["k"], [0, 3.3, 50, 97, 100], method=method).collect()}
        assert [got[q] for q in sorted(got)] == pytest.approx([np.percentile(x, q, method=method) for q in sorted(got)])


def test_bca_against_numpy(spark):
    x = np.random.default_rng(2).gamma(2, 5, 30)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    n = 400
    boot = [r.s for r in E.resample(df, ["k"], "x", n).groupBy("sample").agg(F.avg("x").alias("s")).collect()]
    from statistics import NormalDist

    phi = NormalDist()
    z0 = phi.inv_cdf(np.mean(np.array(boot) < x.mean()))
    jack = np.array([np.delete(x, i).mean() for i in range(len(x))])
    dev = jack.mean() - jack
    a = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    for r in E.confidence_interval(df, ["k"], samples=n).collect():
        z = z0 + phi.inv_cdf(r.alpha)
        at = round((n - 1) * phi.cdf(z0 + z / (1 - a * z)))
        assert r.bound == pytest.approx(np.sort(boot)[at])
    assert np.std(boot) == pytest.approx(x.std() / math.sqrt(len(x)), rel=0.12)


def test_lag_is_found(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=400)
    rows = [("a", date(2001, 1, 1) + timedelta(days=i), float(x[i]), float(x[i - 3]) if i >= 3 else None) for i in range(400)]
    got = K.lag_correlation(spark.createDataFrame(rows, "k string, t date, sim double, obs double"), ["k"], list(range(-10, 11))).first()
    assert got.lag == 3 and got.lag_rho == pytest.approx(1)


def test_rank_sums(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([("a", float(v)) for v in r.integers(0, 9, 50)] + [("a", None)], "k string, x double")
    assert K.rank(df, ["k"]).agg(F.sum("rank")).first()[0] == 50 * 51 / 2
    assert K.rank(df, ["k"]).where("x is null").first()["rank"] is None


def test_label_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(Exception, match="no such label"):
        R.select_labels(df, spark.createDataFrame([(0, 9)], "ordinal int, k int"), "k").collect()
    with pytest.raises(Exception, match="labels differ"):
        R.align_exact(df, df.where("k = 1").withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(Exception, match="labels repeat"):
        R.unique_labels(df.union(df), ["k"]).collect()


def test_nearest_points_by_brute_force(spark):
    r = np.random.default_rng(6)
    a, b = r.uniform([-30, 30], [30, 70], (80, 2)), r.uniform([-30, 30], [30, 70], (60, 2))
    frame = lambda p: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, lon double, lat double")
    got = {x.id: x for x in G.nearest_points(frame(a), frame(b), 250_000).collect()}
    assert len(got) == 80
    for i, (x, y) in enumerate(a):
        j = int(((b - [x, y]) ** 2).sum(1).argmin())
        la, lb = math.radians(y), math.radians(b[j][1])
        d = 6373000 * math.acos(min(1, math.sin(la) * math.sin(lb) + math.cos(la) * math.cos(lb) * math.cos(math.radians(x - b[j][0]))))
        assert got[i].near_id == (j if d <= 250_000 else None)


def test_annual_max_covers_peaks(spark):
    x = np.random.default_rng(9).gamma(2, 3, 900)
    df = series(spark, x)
    am = {r.year: r.am for r in S.annual_max(df, ["k"]).collect()}
    peaks = S.peaks(df, ["k"]).where("peak is not null").collect()
    assert len(peaks) < len(x) and all(am[r.t.year] >= r.peak for r in peaks)
