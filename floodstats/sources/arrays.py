"""Writers of array files from cell tables: Zarr (version 2) by chunks, classic netCDF by files, GeoTIFF by tiles, flat and PCRaster grids by rows. Every file is the
work of one task, so stores of any size are written by all executors; a chunk, file or tile must fit a task."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import grids, rasters, store, zarr
from .store import get, put

# Classic netCDF's type codes, and its tags of lists.
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "i8": 10}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def write_zarr(df: DataFrame, path: str, variable: str, shape: dict[str, int], chunks: list[int], coords: dict[str, np.ndarray] | None = None, attributes: dict | None = None, fill: float = math.nan, dtype: str = "<f8", value: str = "value", if_exists: str = "overwrite") -> int:
    """df: a position for each dimension of `shape`, and the value -> a Zarr group with the variable and one-dimensional coords, in the
    place of the variable that was there; gives the number of chunks written. Chunks without cells aren't written, as readers fill
    them. if_exists: overwrite, or append, which is an error where the variable is there."""
    zarr.use(df.sparkSession)
    plan = {"shape": shape, "chunks": list(chunks), "dtype": dtype, "fill": None if isinstance(fill, float) and math.isnan(fill) else _plain(fill), "attributes": {k: _plain(x) for k, x in (attributes or {}).items()}, "coords": {k: np.asarray(v, float).tolist() for k, v in (coords or {}).items()}}
    places = {f"_c{i}": F.floor(F.col(d) / c).cast("int") for i, (d, c) in enumerate(zip(shape, chunks))}
    own = df.where(F.col(value).isNotNull()).select(*[F.col(d).cast("int").alias(d) for d in shape], F.col(value).cast("double").alias("value")).withColumns(places)
    dealt = own.repartition(*places).sortWithinPartitions(*places).drop(*places)
    dealt.write.format("zarr").mode(if_exists).option("variable", variable).option("plan", json.dumps(plan)).save(path.rstrip("/"))
    return sum(n[:1].isdigit() for n in store.names(f"{path.rstrip('/')}/{variable}"))


def encode_netcdf(variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A classic netCDF file with 64-bit offsets: {name: (dimensions, values, attributes)}; dimensions take their sizes from the values."""
    sizes: dict[str, int] = {}
    for name, (dims, v, _) in variables.items():
        for d, n in zip(dims, v.shape):
            if sizes.setdefault(d, n) != n:
                raise ValueError(f"{name} has another size of {d}")
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + padded(s.encode())
    listed = lambda tag, items: struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attribute(key: str, v) -> bytes:
        if isinstance(v, str):
            return text(key) + struct.pack(">ii", _CODES["S1"], len(v.encode())) + padded(v.encode())
        a = np.atleast_1d(v)
        kind = "i4" if a.dtype.kind in "iu" and a.dtype.itemsize > 2 else a.dtype.str[1:]
        return text(key) + struct.pack(">ii", _CODES[kind], len(a)) + padded(a.astype(f">{kind}").tobytes())

    order = list(sizes)
    every = [padded(np.ascontiguousarray(v, v.dtype.newbyteorder(">")).tobytes()) for _, v, _ in variables.values()]

    def head(begin: int) -> bytes:
        out, at = [], begin
        for (name, (dims, v, attrs)), data in zip(variables.items(), every):
            out.append(text(name) + struct.pack(f">i{len(dims)}i", len(dims), *(order.index(d) for d in dims)) + listed(_ATTRIBUTE, [attribute(*x) for x in attrs.items()]) + struct.pack(">iIq", _CODES[v.dtype.str[1:]], min(len(data), 2**32 - 1), at))
            at += len(data)
        dimensions = [text(d) + struct.pack(">i", sizes[d]) for d in order]
        return b"CDF\2" + struct.pack(">i", 0) + listed(_DIMENSION, dimensions) + listed(_ATTRIBUTE, [attribute(*x) for x in (attributes or {}).items()]) + listed(_VARIABLE, out)

    return head(len(head(0))) + b"".join(every)


def write_netcdf(df: DataFrame, path: str, variable: str, coords: list[str], by: str, value: str = "value", fill: float = -9999.0, attributes: dict | None = None, coord_attributes: dict[str, dict] | None = None) -> int:
    """A file <by>=<value>.nc for each value of `by` (a year, a member): the variable over the distinct values of its coords, which are
    coordinate variables; gives the number of files. Missing cells hold the fill value."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        axes, place = zip(*(np.unique(own[c].to_numpy(float), return_inverse=True) for c in coords))
        v = np.full([len(a) for a in axes], fill)
        v[place] = own[value].to_numpy(float)
        named = {c: ([c], a, (coord_attributes or {}).get(c, {})) for c, a in zip(coords, axes)}
        put(f"{path}/{by}={own[by].iloc[0]}.nc", encode_netcdf({**named, variable: (coords, v, {"_FillValue": fill, **(attributes or {})})}))
        return pd.DataFrame({"n": [len(own)]})

    ship(df.sparkSession)
    store.remove(path)  # files of values that df no longer has
    return df.where(F.col(value).isNotNull()).select(by, *coords, value).groupBy(by).applyInPandas(one, "n long").count()


def write_geotiff_tiles(cells: DataFrame, path: str, west: float, north: float, dx: float, dy: float, side: int = 512, missing: float = -9999.0, dtype: str = "f4") -> int:
    """cells (row, col, value), rows from the north (dy > 0 is a cell's height) -> GeoTIFFs of side x side cells named
    <tile row>_<tile column>.tif; gives their number."""

    def tile(own: pd.DataFrame) -> pd.DataFrame:
        r, c = int(own["_r"].iloc[0]), int(own["_c"].iloc[0])
        v = np.full((1, side, side), missing, dtype)
        v[0, own["row"].to_numpy() - r * side, own["col"].to_numpy() - c * side] = own["value"]
        put(f"{path}/{r}_{c}.tif", rasters.encode_geotiff(v, west + c * side * dx, north - r * side * dy, dx, dy, missing))
        return pd.DataFrame({"n": [len(own)]})

    ship(cells.sparkSession)
    store.remove(path)
    return _by_tile(cells, side).groupBy("_r", "_c").applyInPandas(tile, "n long").count()


def update_geotiff_tiles(cells: DataFrame, path: str, side: int = 512) -> int:
    """New values of some cells put into the tiles that write_geotiff_tiles made; gives the number of tiles that were rewritten.
    Only tiles with new cells are read. A tile that isn't there yet is an error."""

    def tile(own: pd.DataFrame) -> pd.DataFrame:
        r, c = int(own["_r"].iloc[0]), int(own["_c"].iloc[0])
        name = f"{path}/{r}_{c}.tif"
        v, (west, north, dx, dy), missing = rasters.decode_geotiff(get(name))
        v[0, own["row"].to_numpy() - r * side, own["col"].to_numpy() - c * side] = own["value"]
        put(name, rasters.encode_geotiff(v, west, north, dx, -dy, missing))
        return pd.DataFrame({"n": [len(own)]})

    ship(cells.sparkSession)
    return _by_tile(cells, side).groupBy("_r", "_c").applyInPandas(tile, "n long").count()


def _by_tile(cells: DataFrame, side: int) -> DataFrame:
    return cells.where("value is not null").select("row", "col", "value", F.floor(F.col("row") / side).cast("int").alias("_r"), F.floor(F.col("col") / side).cast("int").alias("_c"))


def _by_rows(cells: DataFrame, path: str, rows: int, cols: int, block: int, missing: float, dtype: str, kind: str, encode: Callable[[int, np.ndarray], bytes]) -> int:
    """Files of `block` rows. A task makes many, one after the other, from cells in the files' order."""
    files = -(-rows // block)

    def write(k: int, v: np.ndarray) -> int:
        put(f"{path}/part-{k:05d}.{kind}", encode(k, v))
        return k

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, v = -1, np.empty(0)
        for f in frames:
            ks, row, col, value, on = (f[c].to_numpy() for c in ("_k", "row", "col", "value", "_on"))
            cuts, done = [0, *(np.flatnonzero(np.diff(ks)) + 1), len(ks)] if len(ks) else [], []
            for a, z in pairwise(cuts):
                if ks[a] != k:
                    done += [write(k, v)] if k >= 0 else []
                    k = int(ks[a])
                    v = np.full((min(block, rows - k * block), cols), missing, dtype)
                own = on[a:z]
                v[row[a:z][own] - k * block, col[a:z][own]] = value[a:z][own]
            yield pd.DataFrame({"k": done})
        if k >= 0:
            yield pd.DataFrame({"k": [write(k, v)]})

    spark = cells.sparkSession
    ship(spark)
    store.remove(path)
    k, x = F.floor(F.col("row") / block), F.col("value")
    on = x.isNotNull() & ~F.isnan(x.cast("double"))
    own = cells.where(k.between(0, files - 1)).select(k.cast("int").alias("_k"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce(x, F.lit(0).cast(cells.schema["value"].dataType)).alias("value"), on.alias("_on"))
    every = spark.range(files).select(F.col("id").cast("int").alias("_k"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).cast(cells.schema["value"].dataType).alias("value"), F.lit(False).alias("_on"))
    dealt = own.unionByName(every).repartition(grids.tasks_for(spark, files, rows * cols * 8), "_k").sortWithinPartitions("_k")
    return dealt.mapInPandas(parts, "k int").count()


def write_binary(cells: DataFrame, path: str, rows: int, cols: int, block: int = 512, missing: float = -9999.0, dtype: str = "<f4") -> int:
    """A flat grid of any size in files of `block` rows each, part-00000.bin and so on, which one after the other are the grid; gives
    their number. Rows without cells are written too."""
    return _by_rows(cells, path, rows, cols, block, missing, dtype, "bin", lambda k, v: v.tobytes())


def write_pcraster(cells: DataFrame, path: str, rows: int, cols: int, west: float, north: float, size: float, block: int = 512) -> int:
    """A grid of any size in PCRaster maps of `block` rows each, part-00000.map and so on, each with its own northern edge; gives their
    number."""
    return _by_rows(cells, path, rows, cols, block, np.nan, "<f8", "map", lambda k, v: rasters.encode_pcraster(v, west, north - k * block * size, size))
