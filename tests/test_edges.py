"""Rows that joins and windows could lose: repeated points, nulls beside the keys, the poles and the antimeridian; and paths of any length."""

import math
import random

import pytest
from floodstats.operators import extremes as E
from floodstats.operators import network as N
from floodstats.operators import spatial as S


def metres(a, b, r=6373000.0):
    (x, y), (u, v) = ((math.radians(p[0]), math.radians(p[1])) for p in (a, b))
    return math.acos(min(1, max(-1, math.sin(y) * math.sin(v) + math.cos(y) * math.cos(v) * math.cos(x - u)))) * r


def test_repeated_points_in_polygons(spark):
    box = [("a", 0, 0, 4, 0), ("a", 4, 0, 4, 4), ("a", 4, 4, 0, 4), ("a", 0, 4, 0, 0)]
    hole = [("a", 1, 1, 2, 1), ("a", 2, 1, 2, 2), ("a", 2, 2, 1, 2), ("a", 1, 2, 1, 1)]
    edges = spark.createDataFrame([(z, *map(float, e)) for z, *e in box + hole], "zone string, x1 double, y1 double, x2 double, y2 double")
    rows = [(3.0, 3.0, "p"), (3.0, 3.0, "p"), (3.0, 3.0, None), (1.5, 1.5, "hole"), (9.0, 1.0, "out"), (0.5, 3.9, None)]
    points = spark.createDataFrame(rows, "lon double, lat double, name string")
    for bands in (1, 7, 512):
        got = sorted(((r.lon, r.lat, r.name) for r in S.in_polygons(points, edges, bands=bands).collect()), key=str)
        assert got == sorted([r for r in rows if r[2] not in ("hole", "out")], key=str)
    assert S.in_polygons(points, edges.limit(0)).count() == 0


def test_random_polygons_against_the_plain_rule(spark):
    r = random.Random(4)
    edges = []
    for z in range(6):
        pts = [(r.uniform(0, 20), r.uniform(0, 20)) for _ in range(7)]
        edges += [(z, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]
    points = [(i, r.uniform(-1, 21), r.uniform(-1, 21)) for i in range(400)]
    want = set()
    for i, x, y in points:
        for z in range(6):
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for k, x1, y1, x2, y2 in edges if k == z) % 2:
                want.add((i, z))
    got = S.in_polygons(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(edges, "zone long, x1 double, y1 double, x2 double, y2 double"))
    assert {(r.id, r.zone) for r in got.collect()} == want


def test_interpolation_keeps_every_target(spark):
    anchors = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 5.0, 1.0)], "k string, a double, b double")
    rows = [("a", 1.8, None), ("a", 1.8, None), ("a", 1.8, "x"), ("a", 3.0, None), ("a", 9.0, "y"), ("a", 0.0, None), ("a", None, "z"), ("c", 1.0, None), ("b", 5.0, None)]
    targets = spark.createDataFrame(rows, "k string, at double, note string")
    for clamp, high, low in ((True, 30.0, 10.0), (False, None, None)):
        got = sorted((tuple(r) for r in E.interpolate(targets, anchors, ["k"], "at", "a", "b", clamp, "y").collect()), key=str)
        want = {1.8: 18.0, 3.0: 30.0, 9.0: high, 0.0: low, None: None}
        expect = sorted(((*r, None if r[0] == "c" else 1.0 if r[0] == "b" else want[r[1]]) for r in rows), key=str)
        assert [(a, b, c, None if d is None else round(d, 9)) for a, b, c, d in got] == expect


@pytest.mark.parametrize("metric", ["sphere", "degree"])
def test_nearest_points_everywhere(spark, metric):
    r = random.Random(1)
    place = lambda i: (i, r.uniform(-180, 180), r.choice([r.uniform(-90, 90), r.uniform(80, 90), r.uniform(-3, 3)]))
    left, right = [place(i) for i in range(300)] + [(300, 179.99, 0.0)], [place(i) for i in range(300)] + [(300, -179.99, 0.0)]
    far = 400_000
    df = lambda rows: spark.createDataFrame(rows, "id long, lon double, lat double")
    got = {x.id: x.near_id for x in S.nearest_points(df(left), df(right), far, metric=metric).collect()}
    for i, lon, lat in left:
        by = {j: metres((lon, lat), (u, v)) if metric == "sphere" else (lon - u) ** 2 + (lat - v) ** 2 for j, u, v in right}
        j = min(by, key=lambda k: (by[k], k))
        assert got[i] == (j if metres((lon, lat), right[j][1:]) <= far else None), i


def test_snapping_by_hand(spark):
    """Scores by definition: the error of area counts by the tolerance. At 84 degrees north, and across the antimeridian."""
    gauges = spark.createDataFrame([(1, 10.0, 84.0, 100.0), (2, 179.99, 0.0, 50.0), (3, 0.0, 45.0, 100.0)], "id long, lon double, lat double, area double")
    cells = [(0, 0, 11.6, 84.0, 110.0), (0, 1, 10.1, 84.0, 140.0), (1, 0, -179.99, 0.0, 60.0), (2, 0, 0.0, 45.01, 500.0), (2, 1, 0.0, 45.02, 400.0), (2, 2, 0.0, 45.03, 10.0)]
    got = {(r.id, r.fit): r for r in S.snap_gauges(gauges, spark.createDataFrame(cells, "row int, col int, lon double, lat double, uparea double"), 20_000, percent=50.0).collect()}
    d = metres((10.0, 84.0), (11.6, 84.0), 6378137.0)
    assert 18_000 < d < 20_000
    assert (got[1, "dist"].col, got[1, "uparea"].col) == (1, 0)
    assert got[1, "uparea"].upa_relerr == pytest.approx(0.1 / 0.5) and got[1, "uparea"].dist_relerr == pytest.approx(d / 20_000, rel=1e-6)
    near = got[1, "combi"]
    assert near.col == 1 and near.combi_relerr == pytest.approx((0.4 / 0.5 + metres((10.0, 84.0), (10.1, 84.0), 6378137.0) / 20_000) / 2, rel=1e-6)
    assert got[2, "combi"].col == 0 and got[2, "combi"].dist == pytest.approx(2226.4, abs=1) and got[2, "combi"].upa_relerr == pytest.approx(0.4)
    assert got[3, "dist"].col == 1 and got[3, "dist"].upa_local_max == 500.0  # none fits: from the percentile to below the greatest


@pytest.mark.parametrize("steps", [0, 1, 5, 6, 7, 100])
def test_paths_step_by_step(spark, steps):
    edges = spark.createDataFrame([(i, i - 1 if i % 20 else None) for i in range(60)], "id long, next_id long")
    starts, stops = spark.createDataFrame([(19,), (25,), (40,)], "id long"), spark.createDataFrame([(12,)], "id long")
    want = {(s, k, s - k) for s, low in ((19, 12), (25, 20), (40, 40)) for k in range(min(steps, s - low) + 1)}
    assert {tuple(r) for r in N.path_downstream(edges, starts, steps, stops).collect()} == want
    up = {(s, k, s + k) for s, high in ((19, 19), (25, 39), (40, 59)) for k in range(min(steps, high - s) + 1)}
    assert {tuple(r) for r in N.path_upstream(edges, starts, steps).collect()} == up


def test_jackknife_of_every_statistic(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.normal(10, 3, 15).round(1)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)], "k string, x double")
    plain = {"mean": np.mean, "median": np.median, "std": np.std, "min": np.min, "max": np.max, "sum": np.sum}
    for name, f in plain.items():
        j = np.array([f(np.delete(np.sort(v), i)) for i in range(15)])
        d = j.mean() - j
        want = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        got = {x.k: x._a for x in E._acceleration(df, ["k"], "x", name).collect()}
        assert set(got) == {"a"} and got["a"] == pytest.approx(want, abs=1e-9), name


def test_neighbourhoods_in_parts_of_bounded_size(spark, monkeypatch):
    """Parts follow the rows and the other side is never broadcast whole; nulls and repeated cells count as they did."""
    monkeypatch.setattr(S, "ROWS", 100)
    rows = [(i, j, None if (i + j) % 7 == 0 else float(i * j % 5)) for i in range(10) for j in range(12)] + [(3, 3, 9.0)]
    got = S.neighbourhood(spark.createDataFrame(rows, "row int, col int, value double"))
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    at = lambda i, j: [v for r, c, v in rows if abs(r - i) <= 1 and abs(c - j) <= 1 and v is not None]
    have = {(r.row, r.col): r for r in got.collect()}
    assert len(have) == 120
    for (i, j), r in have.items():
        own = [v for a, b, v in rows if (a, b) == (i, j)]
        v = at(i, j)
        assert (r.n, r.low, r.high, r.same) == (len(v) * len(own), min(v), max(v), sum(x == o for x in v for o in own)), (i, j)
        assert r["mean"] == pytest.approx(sum(v) / len(v))


def test_snapping_shuffles_no_pair_of_a_gauge_that_fits(spark):
    """Many cells equally far or of equal area: the first row and column, and the greatest area of all cells in reach."""
    gauges = spark.createDataFrame([(1, 0.0, 0.0, 100.0), (2, 40.0, 0.0, 1.0), (3, 90.0, 0.0, 1.0)], "id long, lon double, lat double, area double")
    cells = [(r, c, x + dx, dy, 90.0 + 20 * (k % 2) if x == 0 else 100.0 + k) for x, r in ((0.0, 5), (40.0, 6)) for k, (c, dx, dy) in enumerate([(3, 0.01, 0.0), (2, -0.01, 0.0), (1, 0.02, 0.0), (0, 0.0, 0.02)])] + [(9, 9, 0.0, 0.1, 900.0)]
    out = S.snap_gauges(gauges, spark.createDataFrame(cells, "row int, col int, lon double, lat double, uparea double"), 20_000, percent=50.0)
    got = {(r.id, r.fit): (r.row, r.col, r.upa_local_max) for r in out.collect()}
    assert got == {(1, "dist"): (5, 2, 900.0), (1, "uparea"): (5, 0, 900.0), (1, "combi"): (5, 2, 900.0), (2, "dist"): (6, 1, 103.0), (2, "uparea"): (6, 1, 103.0), (2, "combi"): (6, 1, 103.0)}
    assert "Window" not in S.snap_gauges(gauges, spark.createDataFrame(cells, "row int, col int, lon double, lat double, uparea double"), 20_000)._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
