"""Self-describing grids as cell tables: GeoTIFF, PCRaster, Zarr and classic netCDF. Files are read by Spark, or by
ranges of bytes (PCRaster), and decoded by Arrow tasks."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import store
from .grids import RANGE, TASKS, binary_files

CELLS = "file string, band int, row int, col int, lon double, lat double, value double"

# TIFF's field types, tags and sample formats.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIE, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_FORMATS = {1: "u", 2: "i", 3: "f"}


def _unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the highest bit on, 256 clears the table, 257 ends."""
    table: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _unpack_bits(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out.append(raw[i + 1 : i + 2 + n])
            i += 2 + n
        else:
            out.append(raw[i + 1 : i + 2] * (257 - n) if n > 128 else b"")
            i += 2 if n > 128 else 1
    return b"".join(out)


# TIFF's codes of compression.
_UNPACK = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}


def decode_geotiff(raw: bytes, window: tuple[int, int, int, int] | None = None, layers: list[int] | None = None) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """(bands, rows, cols) of the first image, (west, north, dx, dy), and the value that means no data.

    Strips or tiles; none, deflate, LZW or PackBits compression, horizontal differencing, any byte order. window: (first row, end, first
    column, end), of which only the blocks are decoded; the place is then the window's. layers: the bands wanted, from 0."""
    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    big = struct.unpack(f"{end}H", raw[2:4])[0] == 43
    at = struct.unpack(f"{end}{'Q' if big else 'I'}", raw[8:16] if big else raw[4:8])[0]
    n = struct.unpack_from(f"{end}{'Q' if big else 'H'}", raw, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for _ in range(n):
        tag, kind = struct.unpack_from(f"{end}HH", raw, at)
        count = struct.unpack_from(f"{end}{'Q' if big else 'I'}", raw, at + 4)[0]
        if kind in _TYPES:
            form = f"{end}{count}s" if kind == 2 else f"{end}{count * len(_TYPES[kind])}{_TYPES[kind][0]}"
            place, room = at + (12 if big else 8), 8 if big else 4
            if struct.calcsize(form) > room:
                place = struct.unpack_from(f"{end}{'Q' if big else 'I'}", raw, place)[0]
            tags[tag] = struct.unpack_from(form, raw, place)
        at += 20 if big else 12
    one = lambda t, default: tags.get(t, (default,))[0]
    cols, rows, bands, squeeze = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1), one(_COMPRESSION, 1)
    if squeeze not in _UNPACK:
        raise ValueError(f"compression {squeeze} is not supported")
    dtype = np.dtype(f"{end}{_FORMATS[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
    tiled, apart = _TILE_W in tags, one(_PLANAR, 1) == 2 and bands > 1
    w, h = (one(_TILE_W, 0), one(_TILE_H, 0)) if tiled else (cols, one(_ROWS, rows))
    top, bottom, first, last = window or (0, rows, 0, cols)
    top, bottom, first, last = max(0, top), min(rows, bottom), max(0, first), min(cols, last)
    wanted = list(range(bands)) if layers is None else list(layers)
    out = np.zeros((len(wanted), max(0, bottom - top), max(0, last - first)), dtype.newbyteorder("="))
    across, down = -(-cols // w), -(-rows // h)
    for k, (place, size) in enumerate(zip(tags[_TILE_OFFSETS if tiled else _OFFSETS], tags[_TILE_COUNTS if tiled else _COUNTS])):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        if y >= bottom or y + h <= top or x >= last or x + w <= first or (apart and plane not in wanted):
            continue
        block = _UNPACK[squeeze](raw[place : place + size])
        depth, height = 1 if apart else bands, h if tiled else min(h, rows - y)
        v = np.frombuffer(block, dtype, height * w * depth).reshape(height, w, depth)
        if one(_PREDICTOR, 1) == 2:
            v = np.cumsum(v, 1, dtype=dtype.newbyteorder("="))
        v = v[max(0, top - y) : bottom - y, max(0, first - x) : last - x].transpose(2, 0, 1)
        r, c = max(y - top, 0), max(x - first, 0)
        if apart:
            out[wanted.index(plane), r : r + v.shape[1], c : c + v.shape[2]] = v[0]
        else:
            out[:, r : r + v.shape[1], c : c + v.shape[2]] = v[wanted]
    dx, dy = tags.get(_SCALE, (1.0, 1.0, 0.0))[:2]
    tie = tags.get(_TIE, (0.0,) * 6)
    west, north = tie[3] - tie[0] * dx + first * dx, tie[4] + tie[1] * dy - top * dy
    text = one(_NODATA, b"").split(b"\0")[0].strip()
    return out, (west, north, dx, -dy), float(text) if text else None


def geotiff_place(raw: bytes) -> tuple[float, float, float, float]:
    """(west, north, dx, dy) of a GeoTIFF, decoding no block."""
    return decode_geotiff(raw, (0, 0, 0, 0))[1]


def encode_geotiff(bands: np.ndarray, west: float, north: float, dx: float, dy: float, missing: float | None = None) -> bytes:
    """A deflated GeoTIFF in geographic coordinates, one strip for each band."""
    bands = np.ascontiguousarray(bands)
    n, rows, cols = bands.shape
    strips = [zlib.compress(b.astype(b.dtype.newbyteorder("<")).tobytes()) for b in bands]
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    offsets = [8 + sum(map(len, strips[:i])) for i in range(n)]
    fields = [(_WIDTH, "I", [cols]), (_HEIGHT, "I", [rows]), (_BITS, "H", [bands.dtype.itemsize * 8] * n), (_COMPRESSION, "H", [8]), (262, "H", [1]), (_OFFSETS, "I", offsets), (_SAMPLES, "H", [n]), (_ROWS, "I", [rows]), (_COUNTS, "I", list(map(len, strips))), (_PLANAR, "H", [2]), (_FORMAT, "H", [kind] * n)]
    fields += [(_SCALE, "d", [dx, abs(dy), 0.0]), (_TIE, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326])]
    if missing is not None:
        fields.append((_NODATA, "s", [f"{missing:g}".encode() + b"\0"]))
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    start = 8 + len(body)
    extra, entries = b"", b""
    for tag, form, values in fields:
        data = values[0] if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        count = len(data) if form == "s" else len(values)
        code = {"H": 3, "I": 4, "d": 12, "s": 2}[form]
        place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", start + 6 + 12 * len(fields) + len(extra))
        extra += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
        entries += struct.pack("<HHI", tag, code, count) + place
    return b"II*\0" + struct.pack("<I", start) + body + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra


def _pcraster_head(raw: bytes) -> tuple[np.dtype, int | None, int, int, tuple[float, float, float, float]]:
    """Of a PCRaster map's first 256 bytes: type and missing value of its cells, rows, columns, and (west, north, dx, dy)."""
    if not raw.startswith(b"RUU CROSS SYSTEM MAP FORMAT"):
        raise ValueError("not a PCRaster map")
    end = "<" if struct.unpack_from("<I", raw, 46)[0] == 1 else ">"
    code = struct.unpack_from(f"{end}H", raw, 66)[0]
    west, north = struct.unpack_from(f"{end}dd", raw, 84)
    rows, cols = struct.unpack_from(f"{end}II", raw, 100)
    dx, dy = struct.unpack_from(f"{end}dd", raw, 108)
    # Cell representations and their missing values.
    dtype, missing = {0x00: ("u1", 255), 0x26: ("i4", -(2**31)), 0x5A: ("f4", None), 0xDB: ("f8", None)}[code]
    return np.dtype(end + dtype), missing, rows, cols, (west, north, dx, -dy)


def decode_pcraster(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """A PCRaster map as floats with NaN for missing cells, and (west, north, dx, dy)."""
    dtype, missing, rows, cols, place = _pcraster_head(raw)
    v = np.frombuffer(raw, dtype, rows * cols, 256).reshape(rows, cols).astype(float)
    return (v if missing is None else np.where(v == missing, np.nan, v)), place


def encode_pcraster(v: np.ndarray, west: float, north: float, size: float) -> bytes:
    """A PCRaster map of 4-byte reals; NaN is missing."""
    rows, cols = v.shape
    head = bytearray(256)
    head[:27] = b"RUU CROSS SYSTEM MAP FORMAT"
    struct.pack_into("<HIHI", head, 32, 2, 0, 1, 1)
    struct.pack_into("<I", head, 46, 1)
    on = v[np.isfinite(v)] if np.isfinite(v).any() else np.zeros(1)
    struct.pack_into("<HH", head, 64, 0xEB, 0x5A)
    struct.pack_into("<f4xf4x", head, 68, on.min(), on.max())
    struct.pack_into("<ddIIddd", head, 84, west, north, rows, cols, size, size, 0.0)
    out = v.astype("<f4")
    raw = out.view("<u4").copy()
    raw[~np.isfinite(out)] = 0xFFFFFFFF
    return bytes(head) + raw.tobytes()


def _cells(path: str, bands: np.ndarray, place: tuple[float, float, float, float], missing: float | None) -> Iterator[pd.DataFrame]:
    west, north, dx, dy = place
    for band, v in enumerate(bands):
        v = v.astype(float)
        on = np.isfinite(v) & (v != missing if missing is not None else True)
        row, col = np.nonzero(on)
        yield pd.DataFrame({"file": path, "band": np.int32(band), "row": row.astype(np.int32), "col": col.astype(np.int32), "lon": west + (col + 0.5) * dx, "lat": north + (row + 0.5) * dy, "value": v[row, col]})


def read_geotiff(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, layers: list[int] | None = None) -> DataFrame:
    """Cells with data of all files of a path. A file is one task's, so mosaics should be tiles. box: (west, south, east, north), whose
    cells' centres alone are wanted: only blocks of it are decoded, and row and col still count from the file's corner."""

    ship(spark)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                window = top = left = None
                if box:
                    west, north, dx, dy = geotiff_place(r.content)
                    edge = lambda v, start, step: math.ceil((v - start) / step - 0.5 - 1e-9)
                    window = (edge(box[3], north, dy), edge(box[1], north, dy) + 1, edge(box[0], west, dx), edge(box[2], west, dx) + 1)
                    top, left = max(0, window[0]), max(0, window[2])
                v, place, missing = decode_geotiff(r.content, window, layers)
                for cells in _cells(r.path, v, place, missing):
                    if layers is not None:
                        cells["band"] = np.array(layers, np.int32)[cells["band"]]
                    if box:
                        cells["row"], cells["col"] = cells["row"] + np.int32(top), cells["col"] + np.int32(left)
                        cells = cells[cells["lon"].between(box[0], box[2]) & cells["lat"].between(box[1], box[3])]
                    yield cells

    return binary_files(spark, path).select("path", "content").mapInPandas(run, CELLS)


def read_pcraster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, split: int = RANGE) -> DataFrame:
    """Cells (file, band, row, col, lon, lat, value) of PCRaster maps. A task reads ranges of rows of at most `split` bytes, so a map may be
    of any size; of a window (first row, last row, first column, last column; the last are left out, and what a map doesn't have)
    only the rows are read."""
    ship(spark)
    r0, r1, c0, c1 = window or (0, 2**31, 0, 2**31)

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file in f["path"]:
                dtype, _, rows, cols, _ = _pcraster_head(head := store.get_range(file, 0, 256))
                step = max(1, split // (cols * dtype.itemsize))
                first = np.arange(r0, min(r1, rows), step)
                yield pd.DataFrame({"path": file, "head": [head] * len(first), "first": first, "n": np.minimum(step, min(r1, rows) - first)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                dtype, missing, _, cols, (west, north, dx, dy) = _pcraster_head(r.head)
                line = cols * dtype.itemsize
                v = np.frombuffer(store.get_range(r.path, 256 + r.first * line, r.n * line), dtype).reshape(r.n, cols)[:, c0:c1].astype(float)
                v = v if missing is None else np.where(v == missing, np.nan, v)
                for own in _cells(r.path, v[None], (west + c0 * dx, north + r.first * dy, dx, dy), None):
                    yield own.assign(row=(own["row"] + r.first).astype(np.int32), col=(own["col"] + c0).astype(np.int32))

    files = binary_files(spark, path).select("path", "length")
    tasks = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1  # from the listing
    each = files.select("path").mapInPandas(ranges, "path string, head binary, first long, n long")
    return each.repartition(max(1, min(TASKS, tasks))).mapInPandas(run, CELLS)


def read_zarr(spark: SparkSession, path: str, variable: str, coords: dict[str, str] | None = None) -> DataFrame:
    """A variable of a Zarr (version 2) group: one row a cell with a position for each of its dimensions, named by
    _ARRAY_DIMENSIONS, and the value; fill values and NaN are left out. coords: {dimension: variable} of one dimension each, which add
    <dimension>_value. A chunk is a partition; conditions on positions and coords leave out chunks (`zarr.py`)."""
    from . import zarr

    zarr.use(spark)
    return spark.read.format("zarr").option("variable", variable).option("coords", json.dumps(coords or {})).load(path)


def decode_netcdf(raw: bytes) -> dict[str, tuple[list[str], np.ndarray, dict]]:
    """Variables (dimensions, values, attributes) of a classic netCDF file (CDF-1, CDF-2 or CDF-5)."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("not a classic netCDF file")
    version, at = raw[3], 4
    kinds = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}

    def number(form: str = "") -> int:
        nonlocal at
        form = form or (">q" if version == 5 else ">i")
        v = struct.unpack_from(form, raw, at)[0]
        at += struct.calcsize(form)
        return v

    def name() -> str:
        nonlocal at
        n = number()
        s = raw[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def listed(item) -> list:
        number(">i")
        return [item() for _ in range(number())]

    def attribute() -> tuple:
        nonlocal at
        key, kind, n = name(), kinds[number(">i")], number()
        v = np.frombuffer(raw, kind, n, at)
        at += -(-v.nbytes // 4) * 4
        return key, v.tobytes().decode() if kind == "S1" else v.tolist() if n != 1 else v[0].item()

    records = number()
    dims = listed(lambda: (name(), number()))
    listed(attribute)

    def variable() -> tuple:
        return name(), [number() for _ in range(number())], dict(listed(attribute)), kinds[number(">i")], number(), number(">i" if version == 1 else ">q")

    variables = listed(variable)
    grows = [bool(d) and dims[d[0]][1] == 0 for _, d, *_ in variables]
    step = sum(v[4] for v, g in zip(variables, grows) if g)
    if sum(grows) == 1:
        step = next(math.prod(dims[i][1] for i in v[1][1:]) * np.dtype(v[3]).itemsize for v, g in zip(variables, grows) if g)
    out = {}
    for (key, d, attrs, kind, _, begin), g in zip(variables, grows):
        shape = [dims[i][1] for i in d]
        if g:
            n = math.prod(shape[1:])
            v = np.stack([np.frombuffer(raw, kind, n, begin + k * step) for k in range(records)]).reshape([records, *shape[1:]]) if records else np.zeros([0, *shape[1:]], kind)
        else:
            v = np.frombuffer(raw, kind, math.prod(shape), begin).reshape(shape)
        out[key] = ([dims[i][0] for i in d], v, attrs)
    return out


def _netcdf_cells(r, variable: str) -> tuple[dict, np.ndarray, np.ndarray, dict]:
    """All variables of a file (a row of path and content); of one its values, where they aren't missing, and its attributes."""
    every = decode_netcdf(r.content)
    if variable not in every:
        raise ValueError(f"{r.path} has no variable {variable}")
    _, v, attrs = every[variable]
    on = np.isfinite(v.astype(float))
    for key in ("_FillValue", "missing_value"):
        if key in attrs:
            on &= v != attrs[key]
    return every, v, on, attrs


def read_netcdf(spark: SparkSession, path: str, variable: str, coords: list[str], told: str | None = None) -> DataFrame:
    """(file, coords..., value) of a variable of classic netCDF files, a task for each file: the values of its coordinate
    variables in the order of its dimensions; scaled, without fill values. told: a coordinate whose attributes are added as the columns
    units and calendar, since files may count from different times."""

    ship(spark)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                every, v, on, attrs = _netcdf_cells(r, variable)
                place = np.nonzero(on)
                own = {c: every[c][1].astype(float)[p] for c, p in zip(coords, place)}
                more = {k: every[told][2].get(k) for k in ("units", "calendar")} if told else {}
                yield pd.DataFrame({"file": r.path, **own, "value": v[on].astype(float) * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0), **more})

    more = ", units string, calendar string" if told else ""
    return binary_files(spark, path).select("path", "content").mapInPandas(run, "file string, " + ", ".join(f"{c} double" for c in coords) + ", value double" + more)


def netcdf_units(spark: SparkSession, path: str, variable: str, coord: str) -> DataFrame:
    """(file, units, calendar): a row for each of the netCDF files in which the variable has a value, with these attributes of a coordinate."""

    ship(spark)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                every, _, on, _ = _netcdf_cells(r, variable)
                if on.any():
                    yield pd.DataFrame({"file": [r.path], **{k: [every[coord][2].get(k)] for k in ("units", "calendar")}})

    return binary_files(spark, path).select("path", "content").mapInPandas(run, "file string, units string, calendar string")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties..., lon, lat) of the point features of a feature collection or of newline-delimited features."""
    feature = f"struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>"
    from pyspark.sql import functions as F

    raw = spark.read.text(path, wholetext=True)
    whole = raw.select(F.from_json("value", f"struct<type: string, features: array<{feature}>>").alias("c"), "value")
    lines = whole.where("c.features is null").select(F.explode(F.split("value", "\n")).alias("v")).where("trim(v) <> ''").select(F.from_json("v", feature).alias("f"))
    every = whole.where("c.features is not null").select(F.explode("c.features").alias("f")).unionByName(lines)
    return every.where("f.geometry.type = 'Point'").select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def control_to_geotiff(control: str, out: str) -> None:
    """A GrADS descriptor's binary file, on a local disk, as a GeoTIFF."""
    from pathlib import Path

    from .grids import read_control

    g = read_control(control)
    v = np.frombuffer(Path(g.file).read_bytes(), g.dtype, g.bands * g.rows * g.cols).reshape(g.bands, g.rows, g.cols)
    Path(out).write_bytes(encode_geotiff((v[:, ::-1] if g.flipped else v).astype(v.dtype.newbyteorder("=")), g.west, g.north, g.dx, g.dy, g.missing))
