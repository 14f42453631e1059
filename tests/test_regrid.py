"""Regridding, rasterising, inverse projection and flow by tiles, against plain definitions."""

import numpy as np
import pytest
from floodstats.functions import scalar as X
from floodstats.operators import network, regrid, spatial
from floodstats.operators.regrid import Axis
from pyspark.sql import functions as F


def grid(spark, v):
    return spark.createDataFrame([(int(r), int(c), None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)], "row int, col int, value double")


def shares(source, target, n, m):
    """Matrix of the share of each source interval in each target interval."""
    s, t = source[0] + source[1] * np.arange(n + 1), target[0] + target[1] * np.arange(m + 1)
    return np.array([[max(0.0, min(max(s[i : i + 2]), max(t[j : j + 2])) - max(min(s[i : i + 2]), min(t[j : j + 2]))) / abs(source[1]) for j in range(m)] for i in range(n)])


@pytest.mark.parametrize("rows, cols", [((10.0, -0.7, 15), (-5.0, 1.3, 12)), ((10.2, -3.1, 4), (-6.0, 0.4, 45)), ((9.0, -1.0, 9), (-5.0, 1.0, 14))])
def test_sums_and_means_by_area(spark, rows, cols):
    v = np.random.default_rng(1).random((10, 14)) * 100
    v[3, 4] = np.nan
    source, target = (Axis(10.0, -1.0, 10), Axis(-5.0, 1.0, 14)), (Axis(*rows), Axis(*cols))
    wr, wc = shares((10.0, -1.0), rows[:2], 10, rows[2]), shares((-5.0, 1.0), cols[:2], 14, cols[2])
    want = wr.T @ np.nan_to_num(v) @ wc
    got = {(r["row"], r["col"]): r.value for r in regrid.regrid(grid(spark, v), source, target).collect()}
    assert all(x == pytest.approx(want[k]) for k, x in got.items()) and sum(got.values()) == pytest.approx(want.sum(), rel=1e-12)
    if rows[0] >= 10 and cols[0] <= -5:  # the target covers the source
        assert sum(got.values()) == pytest.approx(np.nansum(v), rel=1e-9)
    on = ~np.isnan(v)
    part = wr.T @ on @ wc
    mean = {(r["row"], r["col"]): r.value for r in regrid.regrid(grid(spark, v), source, target, "mean").collect()}
    assert all(x == pytest.approx(want[k] / part[k]) for k, x in mean.items()) and len(mean) == (part > 1e-12).sum()


def test_bilinear(spark):
    lat, lon = np.arange(8), np.arange(9)
    plane = 3 * lat[:, None] - 2.0 * lon[None, :] + 1
    source, target = (Axis(-0.5, 1.0, 8), Axis(-0.5, 1.0, 9)), (Axis(0.0, 0.4, 17), Axis(0.1, 0.5, 15))
    got = {(r["row"], r["col"]): r.value for r in regrid.regrid(grid(spark, plane), source, target, "linear").collect()}
    assert len(got) == 17 * 15 and all(x == pytest.approx(3 * (0.2 + 0.4 * r) - 2 * (0.35 + 0.5 * c) + 1) for (r, c), x in got.items())


def test_latitudes_by_area_of_the_sphere(spark):
    v = np.array([[1.0], [1.0]])
    got = regrid.regrid(grid(spark, v), (Axis(-90.0, 90.0, 2), Axis(0.0, 1.0, 1)), (Axis(-90.0, 30.0, 6), Axis(0.0, 1.0, 1)), sphere=True)
    s = np.sin(np.radians([-90, -60, -30, 0, 30, 60, 90]))
    assert [r.value for r in got.orderBy("row").collect()] == pytest.approx(np.diff(s).tolist())


def test_rows_swept_equal_points_tested(spark):
    ring = lambda z, pts: [(z, *a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]
    star = [(10 + 8 * (1 if k % 2 else 0.4) * np.cos(k * np.pi / 5), 9 + 8 * (1 if k % 2 else 0.4) * np.sin(k * np.pi / 5)) for k in range(10)]
    square, hole, touching = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)], [(3.0, 3.0), (3.0, 6.5), (6.5, 6.5), (6.5, 3.0)], [(9.0, 1.0), (12.5, 1.0), (12.5, 9.0), (9.0, 9.0)]
    far = [(-50.0, -50.0), (-40.0, -50.0), (-40.0, 60.0)]
    edges = spark.createDataFrame([tuple(map(float, e[1:])) + (e[0],) for e in ring(1, star) + ring(2, square) + ring(2, hole) + ring(3, touching) + ring(4, far)], "x1 double, y1 double, x2 double, y2 double, zone int")
    rows, cols = Axis(20.0, -0.5, 42), Axis(-1.0, 0.5, 46)
    centres = spark.range(42 * 46).select((F.col("id") / 46).cast("int").alias("row"), (F.col("id") % 46).cast("int").alias("col")).select("row", "col", rows.centre(F.col("row")).alias("lat"), cols.centre(F.col("col")).alias("lon"))
    want = sorted(map(tuple, spatial.in_polygons(centres, edges).select("row", "col", "zone").collect()))
    got = sorted(map(tuple, regrid.rasterise(edges, rows, cols).collect()))
    assert got == want and {z for *_, z in got} == {1, 2, 3}
    assert regrid.rasterise(edges.limit(0), rows, cols).count() == 0


def test_inverse_projection(spark):
    r = np.random.default_rng(6)
    rows = [(float(a), float(b)) for a, b in zip(r.uniform(-180, 180, 400), r.uniform(-80, 84, 400))] + [(3.0, 0.0), (0.0, 60.0), (-177.0, 83.9)]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", X.utm_zone(F.col("lon"), F.col("lat")))
    east, north = X.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    df = df.withColumns({"east": east, "north": north})
    lon, lat = X.utm_inverse(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    for x in df.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(x.lat2 - x.lat) * 111_000 < 1e-3 and abs(x.lon2 - x.lon) * 111_000 * np.cos(np.radians(x.lat)) < 1e-3


def test_flow_by_tiles(spark):
    r = np.random.default_rng(8)
    side = 24
    nxt = {}
    for i in range(side * side):
        y, x = divmod(i, side)
        ways = [(y + a, x + b) for a, b in ((1, 0), (0, 1), (1, 1)) if y + a < side and x + b < side]
        way = ways[r.integers(len(ways))] if ways and r.random() > 0.02 else None
        nxt[i] = way and int(way[0] * side + way[1])
    edges = spark.createDataFrame(list(nxt.items()), "id long, next_id long")
    state = spark.createDataFrame([(i, float(i % 7 + 1)) for i in nxt], "id long, state double")
    tile = (F.floor(F.col("id") / side / 5) * 10 + F.floor(F.col("id") % side / 5)).cast("long")
    want = {x.id: x.state for x in network.accumulate(edges, state).collect()}
    assert {x.id: x.state for x in network.accumulate_tiles(edges, state, tile).collect()} == pytest.approx(want)
    loop = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id long, next_id long")
    for by in (F.col("id") * 0, F.col("id")):
        with pytest.raises(Exception, match="cycle"):
            network.accumulate_tiles(loop, state, by).collect()


def test_a_chain_of_a_million_nodes(spark):
    n = 1_000_000
    edges = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next_id"))
    got = network.accumulate_tiles(edges, edges.select("id", F.lit(1.0).alias("state")), F.floor(F.col("id") / 50_000).cast("long"))
    assert got.where(F.col("state") != F.col("id") + 1).count() == 0 and got.count() == n
