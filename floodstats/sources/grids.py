"""Binary grids: flat arrays and GrADS descriptors, as cell tables (file, band, row, col, value)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import store


@dataclass
class Grid:
    """Shape and place of a grid: bands, rows, columns, the outer corner of the first cell, and the cell's size."""

    bands: int
    rows: int
    cols: int
    west: float
    north: float
    dx: float
    dy: float
    missing: float | None = None
    flipped: bool = True
    dtype: str = "<f4"
    file: str = ""


def read_control(path: str) -> Grid:
    """A GrADS descriptor (.ctl): DSET, UNDEF, OPTIONS, XDEF, YDEF, ZDEF, TDEF, VARS. Rows count from the north; flipped says
    that the file has the southern row first."""
    words = [line.split() for line in Path(path).read_text().splitlines() if line.strip() and not line.lstrip().startswith("*")]
    by = {w[0].upper(): w[1:] for w in words}
    options = [o.lower() for o in by.get("OPTIONS", [])]
    nx, ny = int(by["XDEF"][0]), int(by["YDEF"][0])
    x0, dx, y0, dy = float(by["XDEF"][2]), float(by["XDEF"][3]), float(by["YDEF"][2]), float(by["YDEF"][3])
    at = next(i for i, w in enumerate(words) if w[0].upper() == "VARS")
    variables = words[at + 1 : at + 1 + int(words[at][1])]
    levels = sum(max(1, int(v[1])) for v in variables)
    # The codes of a variable's units column that give its type.
    kinds = {"-1,40,1": "u1", "-1,40,2": "u2", "-1,40,2,-1": "i2", "-1,40,4": "i4"}
    kind = kinds.get(variables[0][2].replace(" ", ""), "f4") if len(variables[0]) > 2 else "f4"
    order = ">" if "big_endian" in options else "<"
    name = by["DSET"][0]
    file = str(Path(path).parent / name[1:]) if name.startswith("^") else name
    return Grid(levels * int(by.get("TDEF", ["1"])[0]), ny, nx, x0 - dx / 2, y0 + (ny - 0.5) * dy, dx, -dy, float(by["UNDEF"][0]) if "UNDEF" in by else None, "yrev" not in options, order + kind, file)


#: Bytes that a task decodes at a time, and the most tasks; files (or runs of RANGE bytes) that a task reads one after the other, and cells that it hands on together.
RANGE, TASKS = 8 << 20, 10_000
RANGES, TOGETHER = 1000, 100_000
_CELLS = "file string, band int, row int, col int, value double"
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Spark's binaryFile of a path or pattern. Where a pattern has many files, Spark lists each in a task of its own, up to 10,000; here a
    task lists many. The setting is read while listing, and then put back."""
    before = spark.conf.get(_LISTERS)
    spark.conf.set(_LISTERS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").load(path)
    finally:
        spark.conf.set(_LISTERS, before)


def _cells(grid: Grid, band: int, first: int, raw: bytes, columns: tuple[int, int], keep_missing: bool) -> dict[str, np.ndarray]:
    """Cells of whole rows of the file, of which the northernmost is `first`."""
    v = np.frombuffer(raw, grid.dtype).reshape(-1, grid.cols)
    v = (v[::-1] if grid.flipped else v)[:, columns[0] : columns[1]].astype(float)
    on = np.isfinite(v) & ((v != np.float64(np.float32(grid.missing))) & (v != grid.missing) if grid.missing is not None else True)
    row, col = np.nonzero(on | keep_missing)
    return {"band": np.full(len(row), band, np.int32), "row": (row + first).astype(np.int32), "col": (col + columns[0]).astype(np.int32), "value": np.where(on, v, np.nan)[row, col]}


def _planes(cols: int, first: int, x: bytes, y: bytes) -> dict[str, np.ndarray]:
    x, y = np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")
    row, col = np.divmod(np.arange(len(x), dtype=np.int32), np.int32(cols))
    return {"row": row + np.int32(first), "col": col, "nextx": x, "nexty": y}


def _together(parts: Iterator[tuple[str, dict[str, np.ndarray]]]) -> Iterator[pd.DataFrame]:
    """Columns of parts of files as frames, small ones joined, as each frame costs more than the cells of a small one."""

    def frame() -> pd.DataFrame:
        file = np.repeat(np.array([p for p, _ in held], object), [len(c["row"]) for _, c in held])
        return pd.DataFrame({"file": file, **{k: np.concatenate([c[k] for _, c in held]) for k in held[0][1]}})

    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[1]["row"])
        if n >= TOGETHER:
            yield frame()
            held, n = [], 0
    if held:
        yield frame()


def tasks_for(spark: SparkSession, ranges: int, size: int) -> int:
    """Into how many tasks ranges of `size` bytes in all are dealt: as many as run at once, more where the bytes or the ranges are many."""
    return max(1, min(TASKS, ranges, max(spark.sparkContext.defaultParallelism, -(-size // RANGE), -(-ranges // RANGES))))


def _ranged(spark: SparkSession, path: str, grid: Grid, bands: list[list[int]], rows: tuple[int, int], split: int, decode: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """decode(bands, first row, the bytes of each of these bands) of every `split` bytes of rows of the bands that are read together. Ranges
    that are less than RANGE bytes in all are one after the other in a task, so a small file is opened once for its bands; a large one is
    the work of many."""
    line, (r0, r1) = np.dtype(grid.dtype).itemsize * grid.cols, rows
    step = max(1, split // line)
    size, most = line * grid.rows, max(map(len, bands))
    run = step * max(1, RANGE // (step * line * most))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
        for f in frames:
            for r in f.itertuples():
                own = bands[r.bands]
                cuts = [(a, min(step, r1 - a)) for a in range(r.first, min(r.first + run, r1), step)]
                raw = store.get_ranges(r.path, ((b * size + (grid.rows - a - n if grid.flipped else a) * line, n * line) for a, n in cuts for b in own))
                for a, _ in cuts:
                    yield r.path, decode(own, a, *[next(raw) for _ in own])

    each = binary_files(spark, path).select("path", F.explode(F.array(*[F.lit(i) for i in range(len(bands))])).alias("bands"))
    each = each.withColumn("first", F.explode(F.sequence(F.lit(r0), F.lit(r1 - 1), F.lit(run))))
    n = each.count()
    return each.repartition(tasks_for(spark, n, n * min(run, r1 - r0) * line * most)).mapInPandas(lambda frames: _together(parts(frames)), schema)


def read_grid(spark: SparkSession, path: str, grid: Grid, keep_missing: bool = False, window: tuple[int, int, int, int] | None = None, bands: list[int] | None = None, split: int = RANGE) -> DataFrame:
    """(file, band, row, col, value) of flat binary files of one shape. Files of over `split` bytes are read by ranges of rows that are dealt
    out over tasks, so a file may be of any size; others go whole to a task. Of a window (first row, last row, first column, last
    column; the last are left out) only the rows are read, and of bands only those named."""
    line = np.dtype(grid.dtype).itemsize * grid.cols
    size, whole = line * grid.rows, (0, grid.rows, 0, grid.cols)
    r0, r1, c0, c1 = window or whole
    if not (0 <= r0 < r1 <= grid.rows and 0 <= c0 < c1 <= grid.cols):
        raise ValueError(f"window {window} isn't within {grid.rows} rows and {grid.cols} columns")
    wanted = list(range(grid.bands)) if bands is None else bands
    if not all(0 <= b < grid.bands for b in wanted):
        raise ValueError(f"bands {bands} aren't among {grid.bands}")
    ship(spark)

    def from_files(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
        for f in frames:
            for r in f.itertuples():
                for band in wanted:
                    yield r.path, _cells(grid, band, 0, r.content[band * size : (band + 1) * size], (c0, c1), keep_missing)

    if not wanted:
        out = spark.createDataFrame([], _CELLS)
    elif size * grid.bands <= split and (r0, r1) == (0, grid.rows):
        out = binary_files(spark, path).select("path", "content").mapInPandas(lambda frames: _together(from_files(frames)), _CELLS)
    else:
        out = _ranged(spark, path, grid, [[b] for b in wanted], (r0, r1), split, lambda own, first, raw: _cells(grid, own[0], first, raw, (c0, c1), keep_missing), _CELLS)
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_next_xy(spark: SparkSession, path: str, rows: int, cols: int, split: int = RANGE) -> DataFrame:
    """(file, row, col, nextx, nexty) of files of two planes of 32-bit integers. A task reads the same rows of both planes, so cells need
    not be brought together."""
    ship(spark)
    return _ranged(spark, path, Grid(2, rows, cols, 0, 0, 1, -1, None, False, "<i4"), [[0, 1]], (0, rows), split, lambda _, first, x, y: _planes(cols, first, x, y), "file string, row int, col int, nextx int, nexty int")


def located(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds lon and lat of the cells' centres."""
    return cells.withColumns({"lon": F.lit(grid.west) + (F.col("col") + 0.5) * grid.dx, "lat": F.lit(grid.north) + (F.col("row") + 0.5) * grid.dy})


def clipped(cells: DataFrame, lon: float, lat: float, meters: float) -> DataFrame:
    """Located cells within a distance of a point: a box first, which prunes row groups, then the sphere. Raises if none is left."""
    from ..functions.scalar import sphere_distance

    dy = meters / 110_000
    dx = dy / max(0.01, float(np.cos(np.radians(min(89.0, abs(lat) + dy)))))
    box = cells.where(F.col("lat").between(lat - dy, lat + dy) & F.col("lon").between(lon - dx, lon + dx))
    out = box.where(sphere_distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= meters)
    if out.isEmpty():
        raise ValueError("no cell in reach")
    return out


def files_by_year(path: str, pattern: str = r"(\d{4})") -> dict[int, str]:
    """Files of a local folder by the year in their name, the last of each."""
    return {int(m[1]): str(p) for p in sorted(Path(path).iterdir()) if (m := re.search(pattern, p.name))}
