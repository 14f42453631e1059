"""Queries over points and grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import regrid as R
from ..operators import spatial as S
from ..operators.nearest import nearest_by_tree
from .data import CELLS, cells, places, places_sql, rounded, table
from .registry import query


def sphere_sql(a: str, b: str, r: str = "6373000e0") -> str:
    return f"acos(least(1e0, greatest(-1e0, sin(radians({a}.lat)) * sin(radians({b}.lat)) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({a}.lon) - radians({b}.lon))))) * {r}"


def gauge_sql(a: str, b: str) -> str:
    return f"acos(least(1e0, greatest(-1e0, cos(radians({b}.lat) - radians({a}.lat)) - cos(radians({a}.lat)) * cos(radians({b}.lat)) * (1 - cos(radians({b}.lon) - radians({a}.lon)))))) * 6378137e0"


def near_sql(by: str) -> str:
    return f"""WITH l AS (SELECT * FROM {places_sql("customer", "c_custkey", 5)}), r AS (SELECT * FROM {places_sql("supplier", "s_suppkey", 0)}),
b AS (SELECT l.id, l.lon, l.lat, r.id AS near_id, {sphere_sql("l", "r")} AS d, row_number() OVER (PARTITION BY l.id ORDER BY {by}, r.id) AS i FROM l CROSS JOIN r)
SELECT id, round(lon, 4) AS lon, round(lat, 4) AS lat, CASE WHEN d <= 600000 THEN near_id END AS near_id, CASE WHEN d <= 600000 THEN round(d, 1) END AS near_dist FROM b WHERE i = 1"""


@query(near_sql("round(pow(l.lon - r.lon, 2) + pow(l.lat - r.lat, 2), 9)"), whole=("near_id",))
def sjoin_nn(spark, sf):
    out = S.nearest_points(places(spark, sf, "customer", "c_custkey", 5), places(spark, sf, "supplier", "s_suppkey", 0), 600000, digits=9)
    return rounded(rounded(out, 1, "near_dist"), 4, "lon", "lat")


@query(near_sql(sphere_sql("l", "r")), whole=("near_id",))
def sjoin_nn_sphere(spark, sf):
    out = S.nearest_points(places(spark, sf, "customer", "c_custkey", 5), places(spark, sf, "supplier", "s_suppkey", 0), 600000, metric="sphere")
    return rounded(rounded(out, 1, "near_dist"), 4, "lon", "lat")


@query(f"WITH {CELLS}, p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}) SELECT id, value FROM (SELECT id, CAST(round((lat + 75) / 3) AS INT) AS row, CAST(round((lon + 180) / 9) AS INT) AS col FROM p) q LEFT JOIN c ON c.row = q.row AND c.col = q.col")
def nearest_cell_extract(spark, sf):
    return S.grid_at_points(cells(spark, sf).select("row", "col", "value"), places(spark, sf, "customer", "c_custkey", 3), -180, -75, 9, 3).select("id", "value")


@query(f"WITH {CELLS}, p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}) SELECT id, value, zone FROM (SELECT id, CAST(floor((lat + 75.05e0) / 3) AS INT) AS row, CAST(floor((lon + 180.05e0) / 9) AS INT) AS col FROM p) q LEFT JOIN c ON c.row = q.row AND c.col = q.col", whole=("zone",))
def raster_sample(spark, sf):
    return S.raster_lookup(places(spark, sf, "customer", "c_custkey", 3), cells(spark, sf).select("row", "col", "value", "zone"), -180.05, -75.05, 9, 3).select("id", "value", "zone")


def _zonal(how: str, f: str):
    def run(spark, sf):
        c = cells(spark, sf)
        return rounded(S.zonal(c.select("row", "col", "value"), c.select("row", "col", "zone"), how), 4)

    query(f"WITH {CELLS} SELECT zone, round({f}(value), 4) AS value FROM c WHERE zone <> 0 GROUP BY 1", name=f"zonal_{how}")(run)


_zonal("mean", "avg")
_zonal("sum", "sum")


@query(
    """SELECT CAST(p_partkey // 40 AS INT) AS row, CAST(p_partkey % 40 AS INT) AS col, sum(l_quantity) AS total, coalesce(sum(CASE WHEN p_size + l_discount * 10 < 10 AND p_size % 2 = 0 THEN l_quantity END), 0) AS low_total
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND p_partkey % 40 < 39 GROUP BY 1, 2"""
)
def catchment_exposure(spark, sf):
    k = F.col("l_partkey")
    fine = table(spark, sf, "lineitem").select((F.floor(k / 40) + 1).cast("int").alias("catmy"), F.when(k % 40 < 39, k % 40 + 1).otherwise(-9).cast("int").alias("catmx"), (F.col("l_discount") * 10).alias("flddif"), F.col("l_quantity").alias("exp"))
    coarse = cells(spark, sf).select("row", "col", F.col("size").cast("double").alias("elevtn"), (F.col("size") % 2 == 0).alias("lecz"))
    return S.catchment_exposure(fine, coarse)


GAUGES = f"""ga AS (SELECT id, lon, lat, 900 + (id % 13) * 60e0 AS area FROM {places_sql("supplier", "s_suppkey", 0)}), ce AS (SELECT id // 40 AS row, id % 40 AS col, id, lon, lat, p_retailprice AS uparea FROM {places_sql("part", "p_partkey", 0)} q JOIN part ON p_partkey = q.id),
ca AS (SELECT ga.id, ga.area, ce.row, ce.col, ce.lon AS clon, ce.lat AS clat, uparea, {gauge_sql("ga", "ce")} AS dist FROM ga CROSS JOIN ce), cb AS (SELECT *, uparea >= 0.5 * area AND uparea < 1.5 * area AS fits FROM ca WHERE dist <= 300000),
cc AS (SELECT *, bool_or(fits) OVER (PARTITION BY id) AS hit, quantile_cont(uparea, 0.99) OVER (PARTITION BY id) AS p, max(uparea) OVER (PARTITION BY id) AS mx FROM cb),
cd AS (SELECT *, abs(uparea - area) / area / 0.5e0 AS ue, dist / 300000 AS de, (abs(uparea - area) / area / 0.5e0 + dist / 300000) / 2 AS co FROM cc WHERE CASE WHEN hit THEN fits ELSE uparea >= p AND uparea < mx END)"""


@query(
    f"WITH {GAUGES} "
    + " UNION ALL ".join(
        f"SELECT id, '{n}' AS fit, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round({c}, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {c}, row, col) AS i FROM cd) WHERE i = 1" for n, c in (("dist", "de"), ("uparea", "ue"), ("combi", "co"))
    )
)
def snap_gauges(spark, sf):
    g = places(spark, sf, "supplier", "s_suppkey", 0).withColumn("area", 900 + (F.col("id") % 13) * 60.0)
    at = places(spark, sf, "part", "p_partkey", 0)
    c = at.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("uparea")), "id").select(F.floor(F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), "lon", "lat", "uparea")
    out = S.snap_gauges(g, c, 300000)
    error = F.when(F.col("fit") == "dist", F.col("dist_relerr")).when(F.col("fit") == "uparea", F.col("upa_relerr")).otherwise(F.col("combi_relerr"))
    return rounded(out.select("id", "fit", "row", "col", error.alias("error")))


@query("SELECT CAST(r.r AS INT) AS row, round(pow(6371000e0, 2) * radians(0.25e0) * (sin(radians(-90 + (r.r + 1) * 0.25e0)) - sin(radians(-90 + r.r * 0.25e0))), 2) AS area FROM (SELECT unnest(range(0, 720)) AS r) r")
def cell_area(spark, sf):
    return spark.range(720).select(F.col("id").cast("int").alias("row"), F.round(X.cell_area(-90 + (F.col("id") + 0.5) * 0.25, 0.25, 0.25), 2).alias("area"))


@query(f"WITH {CELLS}, fi AS (SELECT row * 2 + i.i AS row, col * 2 + j.j AS col, 1 + ((row + col + i.i) % 3) AS area, value / 7 AS density FROM c CROSS JOIN (SELECT unnest(range(0, 2)) AS i) i CROSS JOIN (SELECT unnest(range(0, 2)) AS j) j) SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(density * area, 4) AS people FROM fi")
def density_resample(spark, sf):
    c = cells(spark, sf)
    two = F.array(F.lit(0), F.lit(1))
    fine = c.withColumn("i", F.explode(two)).withColumn("j", F.explode(two)).select((F.col("row") * 2 + F.col("i")).alias("row"), (F.col("col") * 2 + F.col("j")).alias("col"), (1 + (F.col("row") + F.col("col") + F.col("i")) % 3).alias("area"))
    return rounded(S.resample_density(c.select("row", "col", F.col("value").alias("people"), F.lit(7.0).alias("area")), fine, 2), 4)


@query(f"WITH {CELLS} SELECT a.row, a.col, count(b.value) AS n, min(b.value) AS low, max(b.value) AS high, round(avg(b.value), 4) AS mean, count(CASE WHEN a.value = b.value THEN 1 END) AS same FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2")
def neighbour_window(spark, sf):
    return rounded(S.neighbourhood(cells(spark, sf)), 4, "mean")


@query(f"WITH {CELLS}, m AS (SELECT row, col, value FROM c WHERE zone < 4 UNION ALL SELECT row, col, CASE WHEN zone <> 3 THEN value * 2 END FROM c WHERE zone > 1) SELECT row, col, round(sum(value), 4) AS value FROM m GROUP BY 1, 2")
def mosaic_sums(spark, sf):
    c = cells(spark, sf)
    return rounded(S.mosaic_sum(c.where("zone < 4").select("row", "col", "value"), c.where("zone > 1").select("row", "col", F.when(F.col("zone") != 3, F.col("value") * 2).alias("value"))), 4)


@query(f"WITH {CELLS} SELECT row, col, CASE WHEN zone > 3 THEN -size ELSE value END AS value FROM c WHERE zone < 3 OR zone > 3")
def mosaic_coalesce(spark, sf):
    c = cells(spark, sf).where("zone <> 3")
    new = c.select("row", "col", F.when(F.col("zone") > 3, -F.col("size").cast("double")).alias("value"))
    return S.mosaic_update(c.where("zone < 3").select("row", "col", "value"), new.where("value is not null"))


@query(f"WITH {CELLS} SELECT row, col, CASE WHEN zone = 0 THEN 1e20 ELSE greatest(value / 50 - size, 0) END AS depth FROM c")
def flood_depth(spark, sf):
    c = cells(spark, sf)
    return c.select("row", "col", S.flood_depth(F.when(F.col("zone") != 0, F.col("value") / 50), F.col("size").cast("double")).alias("depth"))


@query(f"WITH {CELLS} SELECT zone, round(sum(CASE WHEN value / 1000 - size / 25e0 > 0.01 THEN value ELSE 0 END), 4) AS people FROM c GROUP BY 1")
def dh_exposure(spark, sf):
    c = cells(spark, sf)
    return rounded(c.groupBy("zone").agg(F.sum(S.exposed(F.col("value"), F.col("value") / 1000, F.col("size") / 25.0)).alias("people")), 4)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_coupled(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


UTM = """CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat <= 84 AND lon >= 9 AND lon < 21 THEN 33
WHEN lat >= 72 AND lat <= 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat <= 84 AND lon >= 33 AND lon < 42 THEN 37 ELSE least(60, floor((lon + 180) / 6) + 1) END"""


@query(f"WITH p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}) SELECT id, CAST({UTM} AS INT) AS zone FROM (SELECT id, lon + 0.05e0 AS lon, lat + 0.05e0 AS lat FROM p)")
def utm_zone(spark, sf):
    return places(spark, sf, "customer", "c_custkey", 3).select("id", X.utm_zone(F.col("lon") + 0.05, F.col("lat") + 0.05).alias("zone"))


@query(f"WITH a AS (SELECT * FROM {places_sql('nation', 'n_nationkey', 1)}), b AS (SELECT * FROM {places_sql('region', 'r_regionkey', 2)}) SELECT a.id AS a, b.id AS b, round({sphere_sql('a', 'b')}, 2) AS sphere, round({gauge_sql('a', 'b')}, 2) AS gauge FROM a CROSS JOIN b")
def point_distances(spark, sf):
    side = lambda n, k, s, p: places(spark, sf, n, k, s).select(F.col("id").alias(p), F.col("lon").alias(f"{p}x"), F.col("lat").alias(f"{p}y"))
    both = side("nation", "n_nationkey", 1, "a").crossJoin(F.broadcast(side("region", "r_regionkey", 2, "b")))  # five regions
    xy = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return rounded(both.select("a", "b", X.sphere_distance(*xy).alias("sphere"), X.gauge_distance(*xy).alias("gauge")), 2)


@query(f"WITH p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}) SELECT id, round(CASE WHEN lon + 200 >= 180 THEN lon + 200 - 360 ELSE lon + 200 END, 4) AS lon FROM p")
def antimeridian_recode(spark, sf):
    return rounded(places(spark, sf, "customer", "c_custkey", 3).select("id", X.wrap_longitude(F.col("lon") + 200).alias("lon")), 4)


@query(f"WITH p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}) SELECT id, CASE WHEN lon < 0.02e0 THEN 'west' ELSE 'east' END AS zone FROM p WHERE lon > -99.98e0 AND lon < 100.02e0 AND lat > -29.98e0 AND lat < 40.02e0")
def polygon_mask(spark, sf):
    box = lambda z, a, b: [(z, a, -29.98, b, -29.98), (z, b, -29.98, b, 40.02), (z, b, 40.02, a, 40.02), (z, a, 40.02, a, -29.98)]
    edges = spark.createDataFrame(box("west", -99.98, 0.02) + box("east", 0.02, 100.02), "zone string, x1 double, y1 double, x2 double, y2 double")
    return S.in_polygons(places(spark, sf, "customer", "c_custkey", 3), edges).select("id", "zone")


@query(
    f"""WITH {CELLS}, r AS (SELECT max(row) + 1 AS n FROM c), ty AS (SELECT unnest(range(CAST(ceil(n / 1.5e0) AS BIGINT))) AS y FROM r), tx AS (SELECT unnest(range(54)) AS x),
o AS (SELECT y, x, value * (least(row + 1, 1.5e0 * (y + 1)) - greatest(row, 1.5e0 * y)) * (least(col + 1, 0.75e0 * (x + 1)) - greatest(col, 0.75e0 * x)) AS part
FROM c JOIN ty ON row < 1.5e0 * (y + 1) AND row + 1 > 1.5e0 * y JOIN tx ON col < 0.75e0 * (x + 1) AND col + 1 > 0.75e0 * x)
SELECT CAST(y AS INT) AS row, CAST(x AS INT) AS col, round(sum(part), 4) AS value FROM o GROUP BY 1, 2"""
)
def regrid_sum(spark, sf):
    c = cells(spark, sf)
    n = c.agg(F.max("row")).first()[0] + 1
    one = R.Axis(0.0, 1.0, n), R.Axis(0.0, 1.0, 40)
    return rounded(R.regrid(c, one, (R.Axis(0.0, 1.5, math.ceil(n / 1.5)), R.Axis(0.0, 0.75, 54))), 4, "value")


@query(
    f"""WITH {CELLS}, t AS (SELECT DISTINCT row, 2 * col + k.k AS x FROM c CROSS JOIN (SELECT unnest([0, 1]) AS k) k),
p AS (SELECT row, x, least(39, greatest(0, (x + 0.5e0) / 2 - 0.5e0)) AS pos FROM t), w AS (SELECT row, x, floor(pos) AS i, pos - floor(pos) AS f FROM p),
v AS (SELECT w.row, x, c.value, CASE WHEN c.col = i THEN 1 - f ELSE f END AS w FROM w JOIN c ON c.row = w.row AND (c.col = i OR c.col = i + 1))
SELECT row, CAST(x AS INT) AS col, round(sum(value * w) / sum(w), 4) AS value FROM v WHERE w > 0 GROUP BY 1, 2"""
)
def regrid_linear(spark, sf):
    c = cells(spark, sf)
    n = c.agg(F.max("row")).first()[0] + 1
    return rounded(R.regrid(c, (R.Axis(0.0, 1.0, n), R.Axis(0.0, 1.0, 40)), (R.Axis(0.0, 1.0, n), R.Axis(0.0, 0.5, 80)), "linear"), 4, "value")


@query(
    f"""WITH s AS (SELECT * FROM {places_sql('supplier', 's_suppkey', 11)}), y AS (SELECT unnest(range(360)) AS row), x AS (SELECT unnest(range(720)) AS col)
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, id AS zone FROM s JOIN y ON 90 - (row + 0.5e0) * 0.5e0 > lat - 0.02e0 AND 90 - (row + 0.5e0) * 0.5e0 < lat + 2.03e0 JOIN x ON -180 + (col + 0.5e0) * 0.5e0 > lon - 0.02e0 AND -180 + (col + 0.5e0) * 0.5e0 < lon + 3.03e0"""
)
def polygon_cells(spark, sf):
    """A box around each supplier, as cells of half a degree."""
    s = places(spark, sf, "supplier", "s_suppkey", 11)
    w, e, a, b = F.col("lon") - 0.02, F.col("lon") + 3.03, F.col("lat") - 0.02, F.col("lat") + 2.03
    side = lambda *xy: F.struct(*[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), xy)])
    edges = s.select(F.col("id").alias("zone"), F.inline(F.array(side(w, a, e, a), side(e, a, e, b), side(e, b, w, b), side(w, b, w, a))))
    return R.rasterise(edges, R.Axis(90.0, -0.5, 360), R.Axis(-180.0, 0.5, 720))


@query(f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {places_sql('customer', 'c_custkey', 3)}")
def utm_round_trip(spark, sf):
    p = places(spark, sf, "customer", "c_custkey", 3)
    zone = X.utm_zone(F.col("lon"), F.col("lat"))
    east, north = X.utm(F.col("lon"), F.col("lat"), zone)
    own = p.select("id", zone.alias("zone"), east.alias("east"), north.alias("north"), (F.col("lat") < 0).alias("south"))
    lon, lat = X.utm_inverse(F.col("east"), F.col("north"), F.col("zone"), F.col("south"))
    return rounded(own.select("id", lon.alias("lon"), lat.alias("lat")), 6)


@query(f"""WITH l AS (SELECT * FROM {places_sql("customer", "c_custkey", 5)}), r AS (SELECT * FROM {places_sql("supplier", "s_suppkey", 0)} WHERE id % 2 = 0)
SELECT l.id, round(min({sphere_sql("l", "r")}), 1) AS dist FROM l CROSS JOIN r GROUP BY 1""")
def sjoin_tree(spark, sf):
    """However far the nearest one is."""
    right = places(spark, sf, "supplier", "s_suppkey", 0).where("id % 2 = 0")
    got = nearest_by_tree(places(spark, sf, "customer", "c_custkey", 5), right, leaf=16)
    return got.select("id", F.round("near_dist", 1).alias("dist"))
