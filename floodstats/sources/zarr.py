"""Zarr (version 2) groups as a data source of Spark: read.format("zarr") and write.format("zarr").

Reading: option `variable`, and `coords`, a JSON object {dimension: variable} of one dimension each. A row is a cell: its position in each
dimension, the value, and <dimension>_value for the coords. Conditions on positions and on coords choose the chunks; each that is
left is a partition, and the others are not opened. Cells of fill value, and NaN, are left out.

Writing: each task puts its chunks under a folder of the job's own; when all are done the driver puts that in the place of the old variable,
and where one failed it removes it, so that a store is the old one or the new one, never parts of both. Chunks must come whole
to a task; `arrays.write_zarr` deals them out.

`use(spark)` registers the source, and turns on the session's setting by which Spark hands conditions to sources in Python.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.ship import ship
from . import store

#: What a condition on a value says of a sorted or unsorted list of them.
_TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def unzip(name: str | None, raw: bytes, size: int) -> bytes:
    if name is None:
        return raw
    if name in ("zlib", "gzip"):
        return zlib.decompress(raw, 47)
    if name in ("zstd", "lz4"):
        return pa.decompress(raw, size, name, asbytes=True) if name == "zstd" else pa.decompress(raw[4:], size, "lz4_raw", asbytes=True)
    raise ValueError(f"compressor {name} is not supported")


class Array:
    """An array of a group: what its description says, and its chunks."""

    def __init__(self, path: str, variable: str):
        self.folder = f"{path}/{variable}"
        meta = json.loads(store.get(f"{self.folder}/.zarray"))
        try:
            self.attributes = json.loads(store.get(f"{self.folder}/.zattrs"))
        except FileNotFoundError:
            self.attributes = {}
        self.shape, self.chunk, self.order = meta["shape"], meta["chunks"], meta.get("order", "C")
        self.sep, self.fill, self.dtype = meta.get("dimension_separator", "."), meta.get("fill_value"), meta["dtype"]
        self.squeeze = (meta.get("compressor") or {}).get("id")
        self.dims = self.attributes.get("_ARRAY_DIMENSIONS") or [f"d{i}" for i in range(len(self.shape))]
        self.scale, self.offset = self.attributes.get("scale_factor", 1.0), self.attributes.get("add_offset", 0.0)

    def cells(self, at: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        """(position in each dimension, value) of the cells of a chunk that have data."""
        dtype = np.dtype(self.dtype)
        size = math.prod(self.chunk)
        x = np.frombuffer(unzip(self.squeeze, store.get(f"{self.folder}/{self.sep.join(map(str, at))}"), size * dtype.itemsize), dtype, size).reshape(self.chunk, order=self.order).astype(float)
        on = np.isfinite(x) if dtype.kind == "f" else np.ones(x.shape, bool)
        if isinstance(self.fill, (int, float)):
            on &= x != self.fill
        place = [p + a * c for p, a, c in zip(np.nonzero(on), at, self.chunk)]
        inside = np.logical_and.reduce([p < s for p, s in zip(place, self.shape)])
        return [p[inside] for p in place], (x[on] * self.scale + self.offset)[inside]

    def line(self) -> np.ndarray:
        """All values of an array of one dimension; NaN where there is none."""
        out = np.full(self.shape, np.nan)
        for name in store.names(self.folder):
            if name[:1].isdigit():
                (p,), v = self.cells((int(name),))
                out[p] = v
        return out


@dataclass
class Chunk(InputPartition):
    at: tuple[int, ...]


class ZarrReader(DataSourceReader):
    def __init__(self, path: str, variable: str, coords: dict[str, str]):
        self.array = Array(path, variable)
        self.coords = {d: Array(path, name).line() for d, name in coords.items()}
        self.wanted = [np.ones(-(-s // c), bool) for s, c in zip(self.array.shape, self.array.chunk)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes from each condition what it says of chunks. All are given back, so Spark tests the cells themselves."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            for k, d in enumerate(self.array.dims):
                if name in (d, f"{d}_value") and (type(f) in _TESTS or isinstance(f, In)):
                    v = np.arange(self.array.shape[k]) if name == d else self.coords.get(d, np.zeros(0))
                    ok = np.isin(v, list(f.value)) if isinstance(f, In) else _TESTS[type(f)](v, f.value)
                    self.wanted[k] &= np.isin(np.arange(len(self.wanted[k])), np.flatnonzero(ok) // self.array.chunk[k])
            yield f

    def partitions(self) -> list[Chunk]:
        """The chunks that are there and wanted. Few are named one by one, many by listing the folder."""
        ways = [np.flatnonzero(w).tolist() for w in self.wanted]
        there = {tuple(map(int, n.replace("/", ".").split("."))) for n in store.names(self.array.folder) if n[:1].isdigit()}
        if math.prod(map(len, ways)) < len(there):
            return [Chunk(at) for at in itertools.product(*ways) if at in there]
        return [Chunk(at) for at in sorted(there) if all(w[i] for w, i in zip(self.wanted, at) if i < len(w))]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is wanted
            return
        place, value = self.array.cells(partition.at)
        columns = {d: pa.array(p.astype(np.int32)) for d, p in zip(self.array.dims, place)} | {"value": pa.array(value)}
        for d, v in self.coords.items():
            columns[f"{d}_value"] = pa.array(v[place[self.array.dims.index(d)]], from_pandas=True)
        yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Rows (positions, value), all of a chunk one after the other."""

    def __init__(self, path: str, variable: str, plan: dict, overwrite: bool):
        self.path, self.variable, self.plan, self.overwrite = path, variable, plan, overwrite
        self.staged = f"{path}/.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        dims, chunk = list(self.plan["shape"]), self.plan["chunks"]
        n, at, block = 0, None, None
        fill = math.nan if self.plan["fill"] is None else self.plan["fill"]

        def done() -> None:
            store.put(f"{self.staged}/{'.'.join(map(str, at))}", zlib.compress(block.tobytes(), 1))

        for b in iterator:
            place = np.stack([b.column(d).to_numpy(zero_copy_only=False).astype(np.int64) for d in dims], 1)
            value, own = b.column("value").to_numpy(zero_copy_only=False), place // chunk
            cuts = np.flatnonzero((np.diff(own, axis=0) != 0).any(1)) + 1 if len(own) else []
            for i, j in itertools.pairwise([0, *cuts, len(own)]):
                if j == i:
                    continue
                if at != tuple(own[i]):
                    if at is not None:
                        done()
                    at, block, n = tuple(own[i].tolist()), np.full(chunk, fill, self.plan["dtype"]), n + 1
                block[tuple((place[i:j] - np.array(at) * chunk).T)] = value[i:j]
        if at is not None:
            done()
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        p = self.plan
        store.put(f"{self.staged}/.zarray", json.dumps({"zarr_format": 2, "shape": list(p["shape"].values()), "chunks": p["chunks"], "dtype": p["dtype"], "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN" if p["fill"] is None else p["fill"], "order": "C", "filters": None}).encode())
        store.put(f"{self.staged}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": list(p["shape"]), **p["attributes"]}).encode())
        for name, values in p["coords"].items():
            v = np.array(values, "<f8")
            store.remove(f"{self.path}/{name}")
            store.put(f"{self.path}/{name}/0", zlib.compress(v.tobytes(), 1))
            store.put(f"{self.path}/{name}/.zarray", json.dumps({"zarr_format": 2, "shape": [len(v)], "chunks": [len(v)], "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": None, "order": "C", "filters": None}).encode())
            store.put(f"{self.path}/{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [name]}).encode())
        store.remove(f"{self.path}/{self.variable}")
        store.move(self.staged, f"{self.path}/{self.variable}")
        store.put(f"{self.path}/.zgroup", b'{"zarr_format": 2}')

    def abort(self, messages: list[Written | None]) -> None:
        store.remove(self.staged)


class Zarr(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _coords(self) -> dict[str, str]:
        return json.loads(self.options.get("coords", "{}"))

    def schema(self) -> str:
        dims = Array(self.options["path"].rstrip("/"), self.options["variable"]).dims
        return ", ".join([*(f"`{d}` int" for d in dims), "value double", *(f"`{d}_value` double" for d in self._coords())])

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(self.options["path"].rstrip("/"), self.options["variable"], self._coords())

    def writer(self, schema: StructType, overwrite: bool) -> ZarrWriter:
        path, variable = self.options["path"].rstrip("/"), self.options["variable"]
        if not overwrite and store.names(f"{path}/{variable}"):
            raise ValueError(f"{path}/{variable} is there already")
        return ZarrWriter(path, variable, json.loads(self.options["plan"]), overwrite)


def use(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Zarr)
