"""Grid files, written byte by byte."""

import json
import struct
import zlib

import numpy as np
import pytest
from floodstats.sources import rasters as R


@pytest.mark.parametrize("dtype", ["u1", "i2", "i4", "f4", "f8"])
def test_geotiff_round_trip(dtype):
    v = (np.arange(2 * 5 * 7) % 90).reshape(2, 5, 7).astype(dtype)
    got, place, missing = R.decode_geotiff(R.encode_geotiff(v, -10.5, 50, 0.25, -0.5, 7))
    assert (got == v).all() and got.dtype == v.dtype and place == (-10.5, 50, 0.25, -0.5) and missing == 7


def test_geotiff_tiles_and_differences():
    v = np.arange(6 * 10, dtype=">u2").reshape(6, 10) * 3
    blocks = []
    for y in (0, 4):
        for x in (0, 8):
            b = np.zeros((4, 8), ">u2")
            part = v[y : y + 4, x : x + 8]
            b[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(np.diff(b, axis=1, prepend=b[:, :1] * 0).astype(">u2").tobytes()))
    offsets = [8 + sum(map(len, blocks[:i])) for i in range(4)]
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    fields = [(256, 3, [10]), (257, 3, [6]), (258, 3, [16]), (259, 3, [8]), (317, 3, [2]), (322, 3, [8]), (323, 3, [4]), (324, 4, offsets), (325, 4, list(map(len, blocks)))]
    extra, entries = b"", b""
    for tag, kind, vals in fields:
        data = struct.pack(f">{len(vals)}{'H' if kind == 3 else 'I'}", *vals)
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", at + 6 + 12 * len(fields) + len(extra))
        extra += data if len(data) > 4 else b""
        entries += struct.pack(">HHI", tag, kind, len(vals)) + place
    raw = b"MM\0*" + struct.pack(">I", at) + body + struct.pack(">H", len(fields)) + entries + bytes(4) + extra
    got, _, _ = R.decode_geotiff(raw)
    assert (got[0] == v).all()


def test_geotiff_cells(spark, tmp_path):
    v = np.array([[[1, -9999], [3, 4]]], "f4")
    (tmp_path / "a.tif").write_bytes(R.encode_geotiff(v, 10, 20, 1, -1, -9999))
    got = {(r.row, r.col): (r.lon, r.lat, r.value) for r in R.read_geotiff(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (10.5, 19.5, 1), (1, 0): (10.5, 18.5, 3), (1, 1): (11.5, 18.5, 4)}


def test_pcraster(spark, tmp_path):
    head = bytearray(256)
    head[:27] = b"RUU CROSS SYSTEM MAP FORMAT"
    struct.pack_into("<I", head, 46, 1)
    struct.pack_into("<HH", head, 64, 0xF0, 0x00)
    struct.pack_into("<dd", head, 84, 5.0, 60.0)
    struct.pack_into("<IIdd", head, 100, 2, 2, 0.5, 0.5)
    (tmp_path / "l.map").write_bytes(bytes(head) + bytes([5, 255, 8, 7]))
    got = {(r.row, r.col): (r.lon, r.lat, r.value) for r in R.read_pcraster(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (5.25, 59.75, 5), (1, 0): (5.25, 59.25, 8), (1, 1): (5.75, 59.25, 7)}


def test_zarr(spark, tmp_path):
    v = np.arange(5 * 3, dtype="<f8").reshape(5, 3)
    v[1, 1] = np.nan
    for name, data, chunks, zip_ in (("q", v, (2, 2), "zlib"), ("time", np.array([10.0, 11, 12, 13, 14]), (5,), None)):
        d = tmp_path / "s.zarr" / name
        d.mkdir(parents=True)
        (d / ".zarray").write_text(json.dumps({"shape": data.shape, "chunks": chunks, "dtype": "<f8", "compressor": zip_ and {"id": zip_}, "fill_value": 7.0 if name == "q" else None, "order": "C", "filters": None, "zarr_format": 2}))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["time", "index"][: data.ndim]}))
        for at in np.ndindex(*(-(-s // c) for s, c in zip(data.shape, chunks))):
            block = np.full(chunks, 7.0)
            part = data[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunks))]
            block[tuple(slice(0, s) for s in part.shape)] = part
            (d / ".".join(map(str, at))).write_bytes(zlib.compress(block.tobytes()) if zip_ else block.tobytes())
    got = {(r.time, r["index"]): (r.value, r.time_value) for r in R.read_zarr(spark, f"{tmp_path}/s.zarr", "q", {"time": "time"}).collect()}
    assert got == {(t, i): (v[t, i], 10.0 + t) for t in range(5) for i in range(3) if np.isfinite(v[t, i]) and v[t, i] != 7}


def test_netcdf(spark, tmp_path):
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    dims = struct.pack(">ii", 10, 2) + text("time") + struct.pack(">i", 0) + text("x") + struct.pack(">i", 3)
    atts = struct.pack(">ii", 12, 2) + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5) + text("_FillValue") + struct.pack(">ii", 3, 1) + pad(struct.pack(">h", -1))
    none = struct.pack(">ii", 0, 0)

    def header(begin):
        q = text("q") + struct.pack(">iii", 2, 0, 1) + atts + struct.pack(">iii", 3, 8, begin[0])
        t = text("time") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 6, 8, begin[1])
        x = text("x") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 5, 12, begin[2])
        return b"CDF\1" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 3) + q + t + x

    size = len(header((0, 0, 0)))
    raw = header((size + 12, size + 20, size)) + struct.pack(">3f", 1, 2, 3)
    for k in range(2):
        raw += pad(struct.pack(">3h", 10 * k, -1, 10 * k + 2)) + struct.pack(">d", 100.0 + k)
    (tmp_path / "a.nc").write_bytes(raw)
    got = {(r.time, r.x): r.value for r in R.read_netcdf(spark, str(tmp_path), "q", ["time", "x"]).collect()}
    assert got == {(100.0, 1.0): 0, (100.0, 3.0): 1, (101.0, 1.0): 5, (101.0, 3.0): 6}


def test_geojson(spark, tmp_path):
    f = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"id": 3}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f]}))
    (tmp_path / "b.json").write_text(json.dumps(f) + "\n" + json.dumps({**f, "properties": {"id": 4}}) + "\n")
    assert sorted(map(tuple, R.read_geojson(spark, str(tmp_path), "id: int").collect())) == [(3, 1.5, 2.0), (3, 1.5, 2.0), (4, 1.5, 2.0)]
