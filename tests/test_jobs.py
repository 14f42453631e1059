"""The chained analyses on a small made-up region."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from floodstats.plans import jobs
from pyspark.sql import functions as F

DAYS = 365 * 9


@pytest.fixture(scope="module")
def world(spark):
    r = np.random.default_rng(11)
    start = datetime(1980, 1, 1)
    days = np.arange(DAYS)
    surge = {i: r.gumbel(0, 0.3, DAYS) for i in range(3)}
    rivers, tides = [], []
    for i in range(3):
        for m in ("a", "b", "c"):
            q = 100 + 50 * np.sin(2 * np.pi * days / 365.25) + r.gamma(2, 20, DAYS)
            for scen in ("cmpnd", "runoff"):
                h = 0.01 * q * (i == 0) + 3 * surge[i] * (scen == "cmpnd") * (i != 0) + r.normal(0, 0.01, DAYS)
                rivers += [(scen, m, start + timedelta(days=int(d)), i + 100, float(h[d] + 5), float(q[d])) for d in days]
        tides += [(i, start + timedelta(days=int(d)), float(surge[i][d]), 1.5, -1.0) for d in days]
    return (
        spark.createDataFrame(rivers, "scen string, ensemble string, time timestamp, rivmth_idx int, WSE double, Q double").cache(),
        spark.createDataFrame(tides, "index int, time timestamp, Hskewsurge_day double, Htide_day_max double, Htide_day_min double").cache(),
        spark.createDataFrame([(i, i + 100, 5.0) for i in range(3)], "index int, rivmth_idx int, z0 double"),
    )


def test_rivers_to_classes(spark, world):
    rivers, tides, coupling = world
    own = jobs.select_stations(rivers, coupling, {"cmpnd": "surge", "runoff": "seas"}, "1980-01-02", "1987-12-31", ("1983-01-01", "1983-03-31"))
    assert {r.scen for r in own.select("scen").distinct().collect()} == {"surge", "seas"}
    assert own.where("WSE is null").select("time").distinct().count() == 90
    table = jobs.driver_table(own, tides, "surge")
    assert table.count() == 3 * 3 * 8
    each, vote = jobs.dominant_drivers(table)
    assert each.count() == 9
    got = {r["index"]: r["class"] for r in vote.collect()}
    assert got[1] == got[2] == 1 and got[0] in (2, 3)
    ev = jobs.extreme_values(own, ["surge", "seas"], periods=(2, 10), samples=50)
    assert ev["annual_maxima"].count() == 2 * 3 * 3 * 8 and ev["extreme_values"].count() == 2 * 9 * 2 and ev["extreme_values_ci"].count() == 2 * 9 * 2 * 2
    infl = {r["index"]: r for r in jobs.surge_influence(ev["extreme_values"], ev["extreme_values_ci"], "surge", "seas", 10).collect()}
    assert infl[1].dh > 1 and infl[1].agree and infl[1].significant and abs(infl[0].dh) < 0.5 and not infl[0].significant
    assert jobs.flood_timing(own).count() == 18
    a = {r["index"]: r for r in jobs.station_attributes(own.where("scen = 'surge'"), tides).collect()}
    assert a[1].Htiderange_mean == 2.5 and a[1].Q_amax > a[1].Q_mean and a[1].Hskewsurge_amax_cv > 0


def test_validation(spark, world):
    rivers, _, _ = world
    sim = rivers.where("scen = 'runoff'").select("ensemble", F.col("rivmth_idx").alias("grdc_id"), "time", F.col("Q").alias("outflw"))
    obs = sim.where("ensemble = 'a'").select("grdc_id", F.date_sub(F.to_date("time"), 1).alias("time"), F.col("outflw").alias("discharge"))
    meta = spark.createDataFrame([(100,), (101,)], "grdc_id int")
    daily, annual = jobs.validation(sim, obs, meta, min_years=8)
    got = {(r.ensemble, r.grdc_id): r for r in daily.collect()}
    assert len(got) == 6 and got["a", 100].kge == pytest.approx(1) and got["a", 101].lag == 0 and got["b", 100].kge < 0.9
    top = {(r.ensemble, r.grdc_id): r for r in annual.collect()}
    assert top["a", 100].am_bias == 0 and top["a", 100].am_doy_diff == pytest.approx(0) and top["a", 100].am_doy_corr == pytest.approx(1)


def test_surge_levels_and_forcing(spark):
    t0 = datetime(1999, 12, 31)
    rows = [(1, t0 + timedelta(hours=6 * i), float(np.sin(i)), 0.1 * (i % 3)) for i in range(4 * 800)]
    both = spark.createDataFrame(rows, "index int, time timestamp, tide double, surge double")
    clim, daily = jobs.surge_levels(both.drop("surge"), both.drop("tide"), ["index"])
    assert clim.count() == 12 and daily.count() == 800
    day = daily.where("time = timestamp '2000-01-01'").first()
    v = [r for r in rows if r[1].date().isoformat() == "2000-01-01"]
    assert day.Htide_day_max == max(r[2] for r in v) and day.Hskewsurge_day == pytest.approx(max(r[2] + r[3] for r in v) - max(r[2] for r in v))
    force = jobs.seasonal_forcing(clim, ["index"], both, 2000)
    assert force.count() == 366 * 48 and force.where("x is null").count() == 0
    mid = force.where("t = timestamp '2000-05-15'").first().x
    assert mid == pytest.approx(clim.where("month = 5").first().clim)


def test_people(spark):
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0), (4, None)], "id long, next_id long")
    people = spark.createDataFrame([(i, 10.0 * (i + 1)) for i in range(5)], "id long, people double")
    level = lambda v: spark.createDataFrame([(i, 10.0, float(x)) for i, x in enumerate(v)], "id long, T double, level double")
    mouths = spark.createDataFrame([(7, 1), (8, 0)], "index int, id long")
    got = jobs.people_affected(level([1.0, 2, 2, 1, 5]), level([1.0, 1, 2, 0, 0]), people, edges, mouths)
    assert {r["index"]: r.people_affected for r in got.collect()} == {7: 20.0, 8: 40.0}
    assert {r["index"]: r.expected for r in jobs.expected_impact(got, ["index"]).collect()} == pytest.approx({7: 0.9 * 10, 8: 0.9 * 20})
