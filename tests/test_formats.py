"""Files made by hand, byte by byte, and the commands over files that the writers made."""

import json
import struct
import zipfile

import numpy as np
import pytest
from floodstats.__main__ import main
from floodstats.functions import calendar as T
from floodstats.sources import arrays, rasters, vectors
from pyspark.sql import functions as F


def packed_lzw(data):
    """TIFF's LZW by its definition."""
    bits, table, width = [], {bytes([i]): i for i in range(256)}, 9
    put = lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    at = b""
    for byte in data:
        if at + bytes([byte]) in table:
            at += bytes([byte])
            continue
        put(table[at])
        table[at + bytes([byte])] = len(table) + 2
        if len(table) + 2 == 4095:  # the table is full: clear it
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = next(w for w in (9, 10, 11, 12) if len(table) + 2 < 2**w)
        at = bytes([byte])
    put(table[at])
    put(257)
    text = "".join(bits)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


@pytest.mark.parametrize("size", [1, 5, 300, 9000, 40_000])
def test_lzw(size):
    data = np.random.default_rng(size).integers(0, 9, size, dtype=np.uint8).tobytes()
    assert rasters._unpack_lzw(packed_lzw(data)) == data


def test_packbits():
    assert rasters._unpack_bits(bytes([0xFE, 0xAA, 2, 0x80, 0, 0x2A, 0xFD, 0xAA, 128, 0xF7, 0x22])) == b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa" + b"\x22" * 10


@pytest.mark.parametrize("window", [(0, 7, 0, 9), (2, 5, 3, 4), (6, 99, -3, 2), (3, 3, 1, 5)])
def test_windows_and_layers(window):
    v = np.arange(3 * 7 * 9, dtype="f4").reshape(3, 7, 9)
    raw = rasters.encode_geotiff(v, 10.0, 50.0, 0.5, 0.25)
    for layers in (None, [1], [2, 0]):
        got, (west, north, dx, dy), _ = rasters.decode_geotiff(raw, window, layers)
        a, b, c, d = max(0, window[0]), min(7, window[1]), max(0, window[2]), min(9, window[3])
        assert (got == v[slice(None) if layers is None else layers, a:b, c:d]).all() and (west, north, dx, dy) == (10 + c * 0.5, 50 - a * 0.25, 0.5, -0.25)


def shapefile(kind, records):
    def content(parts):
        pts = [p for part in parts for p in part]
        if kind == 1:
            return struct.pack("<i2d", 1, *pts[0])
        box = (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
        first = np.cumsum([0, *map(len, parts)])[:-1]
        return struct.pack(f"<i4d2i{len(parts)}i", kind, *box, len(parts), len(pts), *first) + b"".join(struct.pack("<2d", *p) for p in pts)

    out = b""
    for i, parts in enumerate(records, 1):
        c = content(parts)
        out += struct.pack(">2i", i, len(c) // 2) + c
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(out) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + out


def dbf(names, rows):
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15) for n in names)
    out = struct.pack("<4BIHH", 3, 100, 1, 1, len(rows), 32 + len(head) + 1, 1 + 12 * len(names)) + bytes(20) + head + b"\r"
    return out + b"".join(b" " + b"".join(str(v).encode().ljust(12) for v in r) for r in rows) + b"\x1a"


def test_shapefiles(spark, tmp_path):
    rings = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]], [[(10, 0), (12, 0), (11, 3), (10, 0)]]]
    for name, kind, records in (("areas", 5, rings), ("towns", 1, [[[(1.5, 2.5)]], [[(-3, 4)]]])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.shp", shapefile(kind, records))
            z.writestr(f"{name}.dbf", dbf(["id", "label"], [(7, "a b"), (8, "c")]))
    points = vectors.read_shapefile(spark, str(tmp_path / "towns.zip"), ["id", "label"]).orderBy("record").collect()
    assert [(r.id, r.label, r.lon, r.lat) for r in points] == [("7", "a b", 1.5, 2.5), ("8", "c", -3.0, 4.0)]
    edges = vectors.read_shapefile(spark, str(tmp_path / "areas.zip"), ["id"], edges=True)
    assert edges.count() == 4 + 4 + 3
    from floodstats.operators.spatial import in_polygons

    at = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (11.0, 1.0), (9.0, 9.0)], "lon double, lat double")
    assert sorted((r.lon, r.id) for r in in_polygons(at, edges, "id").collect()) == [(0.5, "7"), (11.0, "8")]


@pytest.mark.parametrize("calendar, want", [("360_day", [(1999, 2, 30), (1999, 3, 1)]), ("all_leap", [(1999, 2, 29), (1999, 3, 1)]), ("julian", [(1900, 2, 29), (1900, 3, 1)]), ("noleap", [(2000, 2, 28), (2000, 3, 1)])])
def test_days_around_february(spark, calendar, want):
    units = {"julian": "hours since 1900-02-28 12:00:00", "noleap": "hours since 2000-02-27 12:00:00"}.get(calendar, f"hours since 1999-02-{29 if calendar == '360_day' else 28}T12:00:00")
    df = spark.createDataFrame([(24.0,), (48.0,)], "h double")
    rows = df.select(T.cf_parts(F.col("h"), units, calendar).alias("p"), T.cf_time(F.col("h"), units, calendar).alias("t")).collect()
    assert [(r.p.year, r.p.month, r.p.day) for r in rows] == want and {r.p.micros for r in rows} == {12 * 3_600_000_000}
    real = {"360_day": [False, True], "all_leap": [False, True], "julian": [False, True], "noleap": [True, True]}[calendar]
    assert [r.t is not None for r in rows] == real and (rows[1].t.day, rows[1].t.hour) == (1, 12)
    back = df.select(T.cf_parts(-F.col("h") * 4000, units, calendar).alias("p")).collect()
    assert all(1 <= r.p.month <= 12 and 1 <= r.p.day <= 31 and r.p.year < 2000 for r in back)


def test_netcdf_of_attributes_and_kinds():
    v = {"t": (["t"], np.arange(3, dtype="i4"), {"units": "days since 2000-01-01"}), "x": (["t", "s"], np.arange(6, dtype="f4").reshape(3, 2), {"scale_factor": 0.5, "levels": np.array([1, 2, 3])}), "b": (["s"], np.array([1, -2], "i2"), {})}
    got = rasters.decode_netcdf(arrays.encode_netcdf(v, {"title": "three"}))
    assert list(got) == ["t", "x", "b"] and got["t"][2] == {"units": "days since 2000-01-01"} and got["x"][2] == {"scale_factor": 0.5, "levels": [1, 2, 3]}
    assert all((got[k][1] == v[k][1]).all() and got[k][0] == v[k][0] for k in v)


def test_commands(spark, tmp_path, capsys):
    rows = [(int(t), 10.0 + y, 20.0 + x, float(t * 100 + y * 10 + x), t // 2) for t in range(4) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "time double, lat double, lon double, value double, half int".replace("time double", "time long")).withColumn("time", F.col("time").cast("double"))
    arrays.write_netcdf(df, str(tmp_path / "run"), "q", ["time", "lat", "lon"], "half")
    (tmp_path / "points.csv").write_text("index,lon,lat\n5,21.2,10.9\n6,99,0\n")
    ring = [[19.5, 9.5], [21.5, 9.5], [21.5, 11.5], [19.5, 11.5], [19.5, 9.5]]
    (tmp_path / "zones.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"index": 3}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert main(["extract", str(tmp_path / "run/*.nc"), str(tmp_path / "points.csv"), str(tmp_path / "out"), "--variable", "q", "--coords", "time,lat,lon"]) == 0
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(5, float(t), t * 100 + 11.0) for t in range(4)]
    settings = {"items": [{"name": "areas", "files": "*.nc", "where": str(tmp_path / "zones.geojson"), "variable": "q", "coords": ["time", "lat", "lon"], "reducer": "sum"}]}
    (tmp_path / "s.json").write_text(json.dumps(settings))
    capsys.readouterr()
    for said in ("areas", ""):
        assert main(["postprocess", str(tmp_path / "s.json"), str(tmp_path / "run"), str(tmp_path / "post")]) == 0
        assert capsys.readouterr().out.strip() == said
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "post/areas")).collect()) == [(3, float(t), t * 400 + 22.0) for t in range(4)]
    np.arange(12, dtype="<f4").tofile(tmp_path / "g.bin")
    (tmp_path / "g.ctl").write_text("DSET ^g.bin\nUNDEF -9999\nOPTIONS yrev\nXDEF 4 LINEAR 0.5 1\nYDEF 3 LINEAR 0.5 1\nTDEF 1 LINEAR 1jan2000 1dy\nVARS 1\nq 0 99 flow\nENDVARS\n")
    assert main(["bin-to-tif", str(tmp_path / "g.ctl"), str(tmp_path / "tif"), "--side", "2"]) == 0
    cells = rasters.read_geotiff(spark, str(tmp_path / "tif/0/*.tif")).select("lon", "lat", "value").collect()
    assert {tuple(r) for r in cells} == {(c + 0.5, 2.5 - r, float(r * 4 + c)) for r in range(3) for c in range(4)}
    assert main(["run", "no such query", "a", "b"]) == 2 and main(["nothing"]) == 2

