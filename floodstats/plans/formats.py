"""Queries over tables that were written in a format and read back, over calendars, and over functions of the user."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import calendar as T
from ..functions import scalar as X
from ..functions.shared import shared_dir
from ..operators import custom, relational, spatial
from ..sources import arrays, config, grids, rasters, sinks, tables, vectors
from ..sources.store import put
from .data import CELLS, DAILY, cells, daily, places, places_sql, rounded, table
from .registry import query
from .spatial import sphere_sql


def folder(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def shape(spark, sf) -> tuple[int, int]:
    return tuple(x + 1 for x in cells(spark, sf).agg(F.max("row"), F.max("col")).first())


@query(f"WITH {CELLS} SELECT row, col, -90 + row * 0.5e0 AS lat, value FROM c WHERE zone <> 2")
def zarr_store(spark, sf):
    rows, cols = shape(spark, sf)
    path = folder(spark)
    arrays.write_zarr(cells(spark, sf).where("zone <> 2"), path, "level", {"row": rows, "col": cols}, [16, 16], {"row": -90 + np.arange(rows) * 0.5}, {"units": "m"})
    got = rasters.read_zarr(spark, path, "level", {"row": "row"})
    return got.select("row", "col", F.col("row_value").alias("lat"), "value")


@query(f"WITH {CELLS} SELECT row, col, -90 + row * 0.5e0 AS lat, value FROM c WHERE row BETWEEN 3 AND 12 AND col < 20")
def zarr_window(spark, sf):
    """A store that takes the place of a larger one, and a window of it by a coordinate and a position: only its chunks are read."""
    rows, cols = shape(spark, sf)
    path = folder(spark)
    size, lines = {"row": rows, "col": cols}, {"row": -90 + np.arange(rows) * 0.5}
    arrays.write_zarr(cells(spark, sf).withColumn("value", -F.col("value")), path, "level", {"row": rows + 40, "col": cols + 40}, [8, 8])
    arrays.write_zarr(cells(spark, sf), path, "level", size, [8, 8], lines)
    got = rasters.read_zarr(spark, path, "level", {"row": "row"}).where("row_value between -88.5 and -84 and col < 20")
    return got.select("row", "col", F.col("row_value").alias("lat"), "value")


@query(f"WITH {CELLS} SELECT zone, CAST(row AS DOUBLE) AS lat, CAST(col AS DOUBLE) AS lon, value FROM c WHERE zone > 1")
def netcdf_files(spark, sf):
    path = folder(spark)
    own = cells(spark, sf).where("zone > 1").select("zone", F.col("row").cast("double").alias("lat"), F.col("col").cast("double").alias("lon"), "value")
    arrays.write_netcdf(own, path, "level", ["lat", "lon"], "zone")
    got = rasters.read_netcdf(spark, f"{path}/*.nc", "level", ["lat", "lon"])
    return got.select(F.regexp_extract("file", r"zone=(\d+)", 1).cast("long").alias("zone"), "lat", "lon", "value")


def _tiles(spark, sf) -> str:
    path = folder(spark)
    arrays.write_geotiff_tiles(cells(spark, sf).where("zone <> 4"), path, -20.0, 40.0, 1.0, 1.0, 16, dtype="f8")
    return path


def _from_tiles(got):
    at = lambda i: F.regexp_extract("file", r"(\d+)_(\d+)\.tif", i).cast("int") * 16
    return got.select((at(1) + F.col("row")).alias("row"), (at(2) + F.col("col")).alias("col"), "lon", "lat", "value")


_TILED = "SELECT row, col, -20 + col + 0.5e0 AS lon, 40 - row - 0.5e0 AS lat, value FROM c"


@query(f"WITH {CELLS} {_TILED} WHERE zone <> 4")
def geotiff_tiles(spark, sf):
    return _from_tiles(rasters.read_geotiff(spark, f"{_tiles(spark, sf)}/*.tif"))


@query(f"WITH {CELLS}, g AS ({_TILED} WHERE zone <> 4) SELECT * FROM g WHERE lon BETWEEN -9 AND 14.5e0 AND lat BETWEEN 20.5e0 AND 37")
def geotiff_window(spark, sf):
    return _from_tiles(rasters.read_geotiff(spark, f"{_tiles(spark, sf)}/*.tif", (-9.0, 20.5, 14.5, 37.0)))


@query(f"WITH {CELLS} SELECT row, col, CASE WHEN zone = 3 AND col < 20 THEN -size ELSE value END AS value FROM c WHERE zone <> 4")
def geotiff_update(spark, sf):
    path = _tiles(spark, sf)
    arrays.update_geotiff_tiles(cells(spark, sf).where("zone = 3 AND col < 20").select("row", "col", (-F.col("size")).cast("double").alias("value")), path, 16)
    return _from_tiles(rasters.read_geotiff(spark, f"{path}/*.tif")).select("row", "col", "value")


@query(f"WITH {CELLS} SELECT row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM c WHERE zone <> 0")
def pcraster_map(spark, sf):
    rows, cols = shape(spark, sf)
    v = np.frombuffer(sinks.to_binary(cells(spark, sf).where("zone <> 0"), rows, cols, np.nan, "<f8"), "<f8").reshape(rows, cols)
    put(f"{(path := folder(spark))}/a.map", rasters.encode_pcraster(v, 0.0, 0.0, 1.0))
    return rasters.read_pcraster(spark, f"{path}/a.map").select("row", "col", "value")


@query(f"WITH {CELLS} SELECT row, col, col + 5e-1 AS lon, -row - 5e-1 AS lat, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM c WHERE zone <> 0 AND row % 16 BETWEEN 3 AND 12 AND col < 33")
def pcraster_blocks(spark, sf):
    """Maps of 16 rows written by the executors, of which ten rows each are read, by ranges of two."""
    rows, cols = shape(spark, sf)
    arrays.write_pcraster(cells(spark, sf).where("zone <> 0"), path := folder(spark), rows, cols, 0.0, 0.0, 1.0, 16)
    got = rasters.read_pcraster(spark, f"{path}/part-*.map", (3, 13, 0, 33), 2 * cols * 4)
    return got.select((F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 16 + F.col("row")).alias("row"), "col", "lon", "lat", "value")


@query(f"WITH {CELLS} SELECT row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM c WHERE zone <> 1")
def flat_grid(spark, sf):
    rows, cols = shape(spark, sf)
    raw = np.frombuffer(sinks.to_binary(cells(spark, sf).where("zone <> 1"), rows, cols), "<f4").reshape(rows, cols)
    put(f"{(path := folder(spark))}/a.bin", raw[::-1].tobytes())
    return grids.read_grid(spark, f"{path}/a.bin", grids.Grid(1, rows, cols, 0, 0, 1, -1, -9999.0)).select("row", "col", "value")


@query(f"WITH {CELLS} SELECT row, col, value FROM c WHERE zone <> 1 AND (row < 3 OR row > 5)")
def flat_grid_parts(spark, sf):
    rows, cols = shape(spark, sf)
    own = cells(spark, sf).where("zone <> 1 AND (row < 3 OR row > 5)")
    arrays.write_binary(own, path := folder(spark), rows, cols, 3, dtype="<f8")
    last = (rows - 1) // 3  # may have fewer rows
    read = lambda n, k: grids.read_grid(spark, f"{path}/part-{n}.bin", grids.Grid(1, k, cols, 0, 0, 1, -1, -9999.0, False, "<f8"))
    whole = "{" + ",".join(f"{k:05d}" for k in range(last)) + "}"
    got = read(whole, 3).unionByName(read(f"{last:05d}", rows - 3 * last))
    return got.select((F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 3 + F.col("row")).alias("row"), "col", "value")


@query(f"WITH {CELLS} SELECT row, col, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM c WHERE zone <> 1 AND row % 4 IN (1, 2) AND col BETWEEN 5 AND 29 AND row < (SELECT (max(row) + 1) // 4 * 4 FROM c)")
def flat_grid_window(spark, sf):
    """Two rows of each file of four, by ranges of bytes of a row each."""
    rows, cols = shape(spark, sf)
    arrays.write_binary(cells(spark, sf).where(f"zone <> 1 AND row < {rows // 4 * 4}"), path := folder(spark), rows // 4 * 4, cols, 4)
    got = grids.read_grid(spark, f"{path}/part-*.bin", grids.Grid(1, 4, cols, 0, 0, 1, -1, -9999.0, False), window=(1, 3, 5, 30), split=cols * 4)
    return got.select((F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 4 + F.col("row")).alias("row"), "col", "value")


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 40 > 0 THEN p_partkey - 1 END AS BIGINT) AS next_id FROM part")
def flat_next_xy(spark, sf):
    from ..operators import network

    rows, cols = shape(spark, sf)
    n = table(spark, sf, "part").count()
    k = np.arange(rows * cols)
    x, y = np.where(k % cols > 0, k % cols, -9), np.where(k % cols > 0, k // cols + 1, -9)
    x, y = (np.where(k < n, v, -9999).astype("<i4") for v in (x, y))
    put(f"{(path := folder(spark))}/nextxy.bin", x.tobytes() + y.tobytes())
    return network.decode_next_xy(grids.read_next_xy(spark, f"{path}/nextxy.bin", rows, cols), cols)


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 3 = 1 AND p_partkey % 40 > 0 THEN p_partkey - 1 WHEN p_size % 3 = 2 AND p_partkey >= 40 THEN p_partkey - 40 END AS BIGINT) AS next_id FROM part")
def next_xy_planes(spark, sf):
    """Next cells that follow from the parts' sizes, in files of four rows of either plane, read by ranges of a row."""
    from ..operators import network

    rows, cols = shape(spark, sf)
    west, north = (F.col("size") % 3 == 1) & (F.col("col") > 0), (F.col("size") % 3 == 2) & (F.col("row") > 0)
    x = F.when(west, F.col("col")).when(north, F.col("col") + 1).otherwise(-9)  # counted from 1
    y = F.when(west, F.col("row") + 1).when(north, F.col("row")).otherwise(-9)
    planes = F.explode(F.array(F.struct(F.lit(0).alias("p"), x.alias("v")), F.struct(F.lit(1).alias("p"), y.alias("v"))))
    own = cells(spark, sf).select("row", "col", planes.alias("_v"))
    own = own.select((F.floor(F.col("row") / 4) * 8 + F.col("_v.p") * 4 + F.col("row") % 4).cast("int").alias("row"), "col", F.col("_v.v").alias("value"))
    arrays.write_binary(own, path := folder(spark), -(-rows // 4) * 8, cols, 8, dtype="<i4")
    got = grids.read_next_xy(spark, f"{path}/part-*.bin", 4, cols, cols * 4)
    return network.decode_next_xy(got.withColumn("row", F.regexp_extract("file", r"part-(\d+)", 1).cast("int") * 4 + F.col("row")), cols)


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def csv_table(spark, sf):
    path = folder(spark)
    sinks.write_csv(table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name", "c_acctbal"), path, 2)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def text_words(spark, sf):
    put(f"{(path := folder(spark))}/a.txt", "\n".join(["a title", *("  {} {}   {:.2f}".format(*r) for r in table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").toLocalIterator())]).encode())
    return tables.read_words(spark, path, {"s_suppkey": "long", "s_nationkey": "int", "s_acctbal": "double"}, 1)


@query("SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
def text_transposed(spark, sf):
    rows = table(spark, sf, "region").orderBy("r_regionkey").collect()
    put(f"{(path := folder(spark))}/a.txt", f"key {' '.join(str(r.r_regionkey) for r in rows)}\nname {' '.join(r.r_name.replace(' ', '_') for r in rows)}\n".encode())
    return tables.read_transposed(spark, path, {"key": "long", "name": "string"}).withColumn("name", F.replace("name", F.lit("_"), F.lit(" ")))


@query(f"SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {places_sql('customer', 'c_custkey', 3)}")
def geojson_points(spark, sf):
    path = folder(spark)
    sinks.write_geojson(places(spark, sf, "customer", "c_custkey", 3), path)
    return rounded(rasters.read_geojson(spark, path, "id: long").select("id", "lon", "lat"))


_RINGS = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"zone":"one"},"geometry":{"type":"Polygon","coordinates":[[[-99.98,-29.98],[0.02,-29.98],[0.02,40.02],[-99.98,40.02],[-99.98,-29.98]],[[-50.02,-10.02],[-40.02,-10.02],[-40.02,10.02],[-50.02,10.02],[-50.02,-10.02]]]}},{"type":"Feature","properties":{"zone":"two"},"geometry":{"type":"MultiPolygon","coordinates":[[[[10.02,0.02],[60.02,0.02],[60.02,40.02],[10.02,40.02],[10.02,0.02]]],[[[100.02,0.02],[110.02,0.02],[110.02,60.02],[100.02,60.02],[100.02,0.02]]]]}}]}'


@query(
    f"""WITH p AS (SELECT * FROM {places_sql('customer', 'c_custkey', 3)}), q AS (SELECT id, lon BETWEEN -99.98e0 AND 0.02e0 AND lat BETWEEN -29.98e0 AND 40.02e0 AND NOT (lon BETWEEN -50.02e0 AND -40.02e0 AND lat BETWEEN -10.02e0 AND 10.02e0) AS a,
(lon BETWEEN 10.02e0 AND 60.02e0 AND lat BETWEEN 0.02e0 AND 40.02e0) OR (lon BETWEEN 100.02e0 AND 110.02e0 AND lat BETWEEN 0.02e0 AND 60.02e0) AS b FROM p)
SELECT id, CASE WHEN a THEN 'one' ELSE 'two' END AS zone FROM q WHERE a OR b"""
)
def geojson_polygons(spark, sf):
    put(f"{(path := folder(spark))}/a.geojson", _RINGS.encode())
    return spatial.in_polygons(places(spark, sf, "customer", "c_custkey", 3), vectors.read_polygons(spark, path, "zone: string")).select("id", "zone")


@query("SELECT o_orderkey, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) = 1997")
def files_by_year(spark, sf):
    path = folder(spark)
    own = sinks.provenance(sinks.described(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), {"o_orderdate": {"long_name": "date of order"}}), "test", "query")
    sinks.write_by_year(own, path, "o_orderdate", if_exists="error")
    if not sinks.exists(spark, path):
        raise ValueError("nothing was written")
    return spark.read.parquet(path).where("year = 1997").select("o_orderkey", F.col("year").cast("long").alias("year"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '1-URGENT'")
def settings_files(spark, sf):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as d:  # read and written by the driver alone
        Path(d, "a.nml").write_text(config.write_namelist({"run": {"limit": 250000.0, "which": "1-URGENT", "dry": False}}))
        Path(d, "a.ini").write_text("[names]\nPrice = o_totalprice ; a column\n")
        Path(d, "a.json").write_text('{"columns": ["o_orderkey", "o_totalprice"]}')
        own, names, js = config.read_namelist(f"{d}/a.nml")["run"], config.read_ini(f"{d}/a.ini")["names"], config.read_json(f"{d}/a.json")
    out = table(spark, sf, "orders").where((F.col(names["Price"]) > own["limit"]) & (F.col("o_orderpriority") == own["which"]))
    return out.select(*js["columns"]) if not own["dry"] else out.limit(0)


@query(f"WITH {CELLS} SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, a.value AS level, b.size FROM (SELECT * FROM c WHERE zone < 3 OR zone = 4) a FULL JOIN (SELECT * FROM c WHERE zone > 1) b ON a.row = b.row AND a.col = b.col", whole=("size",))
def combine_by_coords(spark, sf):
    c = cells(spark, sf)
    level = lambda z: c.where(z).select("row", "col", F.col("value").alias("level"))
    return relational.by_coords([level("zone < 2"), c.where("zone > 1").select("row", "col", "size"), level("zone IN (1, 2, 4)")], ["row", "col"])


_DAY = "SELECT p_partkey AS k, p_partkey * 11 + p_size AS d FROM part"


def _offsets(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 11 + F.col("p_size")).alias("d"))


def _parts(spark, sf, name):
    p = T.cf_parts(F.col("d"), "days since 1999-03-01", name)
    return _offsets(spark, sf).select("k", p["year"].cast("long").alias("y"), p["month"].cast("long").alias("m"), p["day"].cast("long").alias("day"))


@query(f"SELECT k, 1999 + (d + 60) // 360 AS y, (d + 60) % 360 // 30 + 1 AS m, (d + 60) % 30 + 1 AS day FROM ({_DAY})")
def calendar_360_day(spark, sf):
    return _parts(spark, sf, "360_day")


@query(f"WITH o AS (SELECT k, 1999 + (d + 59) // 365 AS y, DATE '2001-01-01' + CAST((d + 59) % 365 AS INT) AS t FROM ({_DAY})) SELECT k, y, month(t) AS m, day(t) AS day FROM o")
def calendar_noleap(spark, sf):
    return _parts(spark, sf, "noleap")


@query(f"WITH o AS (SELECT k, 1999 + (d + 60) // 366 AS y, DATE '2000-01-01' + CAST((d + 60) % 366 AS INT) AS t FROM ({_DAY})) SELECT k, y, month(t) AS m, day(t) AS day FROM o")
def calendar_all_leap(spark, sf):
    return _parts(spark, sf, "all_leap")


@query(f"WITH o AS (SELECT k, DATE '1999-03-01' + CAST(d AS INT) AS t FROM ({_DAY})) SELECT k, CAST(year(t) AS BIGINT) AS y, month(t) AS m, day(t) AS day FROM o WHERE t < DATE '2100-03-01'")
def calendar_julian(spark, sf):
    """Julian and civil dates run alike from one century's missing leap day to the next."""
    return _parts(spark, sf, "julian").where("y < 2100 OR (y = 2100 AND (m < 2 OR (m = 2 AND day < 29)))")


@query(f"WITH {DAILY}, r AS (SELECT k, t, sum(x) OVER (PARTITION BY k ORDER BY t) AS y FROM d) SELECT k, t, round(y, 2) AS y FROM r", dates=("t",))
def series_transform(spark, sf):
    return rounded(custom.transform_series(daily(spark, sf), ["k"], np.cumsum).select("k", "t", "y"), 2)


@query(f"WITH {DAILY} SELECT k, max(x) - min(x) AS extent, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1")
def series_reduce(spark, sf):
    return custom.reduce_series(daily(spark, sf), ["k"], lambda x: [np.ptp(x), len(x)], ["x"], ["extent", "n"])


@query(f"WITH {DAILY}, q AS (SELECT k, t, x, row_number() OVER (PARTITION BY k ORDER BY t) % 30 AS i FROM d) SELECT k, t, x FROM q WHERE i = 1", dates=("t",))
def series_apply(spark, sf):
    return custom.apply_series(daily(spark, sf), ["k"], lambda own: own.iloc[::30], "k string, t date, x double")


@query(f"WITH a AS (SELECT id, lon, lat FROM {places_sql('customer', 'c_custkey', 3)}), b AS (SELECT 10e0 AS lon, 20e0 AS lat) SELECT a.id FROM a, b WHERE {sphere_sql('b', 'a')} <= 3000000")
def clipped_cells(spark, sf):
    return grids.clipped(places(spark, sf, "customer", "c_custkey", 3), 10.0, 20.0, 3_000_000).select("id")


def _utm_sql(lon: str, lat: str, zone: str) -> str:
    """Columns n, e, a, s of the series' steps, one below the other."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    r, e = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{c:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(al, 1))
    north = " + ".join(f"{c:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(al, 1))
    return f"""u1 AS (SELECT id, lat, sin(radians({lat})) AS s, radians({lon} - ({zone} * 6 - 183)) AS d FROM u0),
u2 AS (SELECT *, sinh(atanh(s) - {e:.17e} * atanh({e:.17e} * s)) AS t FROM u1), u3 AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM u2)
SELECT id, round(500000 + 0.9996e0 * {r:.17e} * (eta + {east}), 2) AS x, round(0.9996e0 * {r:.17e} * (xi + {north}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 2) AS y FROM u3"""


@query(f"WITH u0 AS (SELECT id, lon + 0.05e0 AS lon, lat + 0.05e0 AS lat FROM {places_sql('customer', 'c_custkey', 3)} WHERE lat < 50), {_utm_sql('lon', 'lat', 'least(60, floor((lon + 180) / 6) + 1)')}")
def utm_coordinates(spark, sf):
    p = places(spark, sf, "customer", "c_custkey", 3).where("lat < 50").select("id", (F.col("lon") + 0.05).alias("lon"), (F.col("lat") + 0.05).alias("lat"))
    x, y = X.utm(F.col("lon"), F.col("lat"), X.utm_zone(F.col("lon"), F.col("lat")))
    return rounded(p.select("id", x.alias("x"), y.alias("y")), 2)
