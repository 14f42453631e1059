"""Nearest points by a tree against every pair: crowded places, points across the antimeridian, no distance set, ties, nulls."""

import re

import numpy as np
import pytest
from floodstats.operators import spatial
from floodstats.operators.nearest import nearest_by_tree


def brute(left, right, metric):
    lon, lat = (np.array([p[i] for p in right]) for i in (1, 2))
    out = {}
    for i, x, y in left:
        if metric == "degree":
            d = (lon - x) ** 2 + (lat - y) ** 2
        else:
            a, b, c, e = map(np.radians, (x, y, lon, lat))
            d = 2 - 2 * (np.cos(b) * np.cos(e) * np.cos(a - c) + np.sin(b) * np.sin(e))
        out[i] = float(d.min()), {right[k][0] for k in np.flatnonzero(d <= d.min() + 1e-13)}
    return out


def points(spark, rows):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in rows], "id long, lon double, lat double")


@pytest.mark.parametrize("metric", ["sphere", "degree"])
def test_against_every_pair(spark, metric):
    r = np.random.default_rng(3)
    crowd = [(k, 10 + 1e-3 * a, 50 + 1e-3 * b) for k, (a, b) in enumerate(r.random((1500, 2)))]
    wide = [(2000 + k, *p) for k, p in enumerate(zip(r.uniform(-180, 180, 200), r.uniform(-90, 90, 200)))]
    right = crowd + wide + [(5000, 179.99, 3.0), (5001, -179.99, -3.0), (5002, 10.0, 50.0), (5003, 10.0, 50.0)]
    left = [(k, *p) for k, p in enumerate(zip(r.uniform(-180, 180, 150), r.uniform(-90, 90, 150)))] + [(200 + k, 10 + 1e-3 * a, 50 + 1e-3 * b) for k, (a, b) in enumerate(r.random((150, 2)))] + [(900, -179.99, 3.0), (901, 0.0, 90.0), (902, 10.0, 50.0)]
    want = brute(left, right, metric)
    got = {x.id: x for x in nearest_by_tree(points(spark, left), points(spark, right), metric=metric, leaf=20).collect()}
    assert len(got) == len(left) and all(got[i].near_id in ids for i, (_, ids) in want.items())
    assert got[902].near_id == 5002 and got[902].near_dist == pytest.approx(0, abs=0.2)


def test_few_points_nulls_and_limits(spark):
    right = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1.0, 0.0, "b"), (3, None, 0.0, "c")], "id long, lon double, lat double, name string")
    left = spark.createDataFrame([(7, 0.6, 0.0, 1), (8, None, 1.0, 2), (9, 30.0, 0.0, 3), (7, 0.1, 0.0, 4)], "id long, lon double, lat double, more int")
    got = {x.more: (x.near_id, x.near_name) for x in nearest_by_tree(left, right, max_dist=1e6).collect()}
    assert got == {1: (2, "b"), 2: (None, None), 3: (None, None), 4: (1, "a")}
    assert {x.near_id for x in nearest_by_tree(left, right.limit(0)).collect()} == {None}
    assert nearest_by_tree(left.limit(0), right).count() == 0


def test_all_points_in_one_place(spark):
    right = points(spark, [(k, 5, 5) for k in range(500)] + [(900, 6, 5)])
    got = nearest_by_tree(points(spark, [(1, 5.2, 5), (2, 5.9, 5)]), right, leaf=4)
    assert {x.id: x.near_id for x in got.collect()} == {1: 0, 2: 900}


@pytest.mark.parametrize("metric", ["sphere", "degree"])
def test_crowded_tiles_go_down_the_tree(spark, metric, monkeypatch):
    """Points on a lattice, so that many are equally far, under a distance that brings most of them together."""
    r = np.random.default_rng(5)
    lattice = lambda n, at: [(at + k, *p) for k, p in enumerate(np.c_[r.integers(0, 90, n) / 10 + 170, r.integers(-40, 40, n) / 10])]
    left, right = lattice(300, 0) + [(900, 0.0, 0.0)], lattice(600, 1000)
    go = lambda: sorted(map(tuple, spatial.nearest_points(points(spark, left), points(spark, right), 500_000, metric=metric, digits=9).collect()))
    tiles = go()
    seen = []
    monkeypatch.setattr(spatial, "nearest_by_tree", lambda *a: seen.append(1) or nearest_by_tree(*a))
    monkeypatch.setattr(spatial, "MET", 0)
    assert go() == tiles and seen and [x[0] for x in tiles] == sorted(x[0] for x in left) and tiles[-1][3] is None
    if metric == "degree":
        want = {i: min((round((u - x) ** 2 + (v - y) ** 2, 9), j) for j, u, v in right)[1] for i, x, y in left if i < 900}
        assert {x[0]: x[3] for x in tiles[:-1]} == want


def test_places_are_looked_up_once(spark, monkeypatch):
    """However many points share a place, a pair of places meets once."""
    met = []
    monkeypatch.setattr(spatial, "_met", lambda l, r, on: met.append((l.count(), r.select("_rlon", "_rlat").distinct().count())) or 0)
    left, right = [(k, 1.0 + k % 2, 2.0) for k in range(100)], [(k, 1.5, 2.0 + k % 3) for k in range(60)]
    got = spatial.nearest_points(points(spark, left), points(spark, right), 300_000).collect()
    assert met[0] == (2, 3) and len(got) == 100 and {x.near_id for x in got} == {0}


@pytest.mark.parametrize("metric", ["sphere", "degree"])
def test_pairs_are_dealt_out_by_their_number(spark, metric, monkeypatch):
    """Few rows with many pairs don't stay in one task, as their bytes alone would have it."""
    r = np.random.default_rng(11)
    left, right = ([(at + k, *p) for k, p in enumerate(np.c_[r.uniform(-30, 30, n), r.uniform(60, 80, n)])] for at, n in ((0, 200), (1000, 300)))
    go = lambda: spatial.nearest_points(points(spark, left), points(spark, right), 400_000, metric=metric)
    whole = sorted(map(tuple, go().collect()))
    monkeypatch.setattr(spatial, "MET_TASK", 500)
    many = go()
    dealt = {int(n) for n in re.findall(r"RepartitionByExpression \[_tx.*\], (\d+)", many._jdf.queryExecution().optimizedPlan().toString())}
    assert sorted(map(tuple, many.collect())) == whole and sum(x[3] is not None for x in whole) > 150 and dealt and min(dealt) > 4
