"""Flat grids by ranges of bytes: the same cells as whole files, of any size, and no more bytes than a window needs."""

import numpy as np
import pytest
from floodstats.sources import arrays, grids, rasters, store
from pyspark.sql import functions as F


def key(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("flipped", [True, False])
@pytest.mark.parametrize("dtype", ["<f4", ">f4", "<i2"])
def test_ranges_equal_whole_files(spark, tmp_path, flipped, dtype):
    r = np.random.default_rng(3)
    g = grids.Grid(3, 17, 11, 0, 0, 1, -1, -9999.0, flipped, dtype)
    planes = {}
    for name in ("a", "b"):
        v = r.integers(-300, 300, (3, 17, 11)).astype(float)
        v[r.random(v.shape) < 0.2] = -9999
        planes[name] = v
        (tmp_path / f"{name}.bin").write_bytes(v.astype(dtype).tobytes())
    want = grids.read_grid(spark, f"{tmp_path}/*.bin", g)
    assert {(x.file[-5], x.band, x.row, x.col): x.value for x in want.collect()} == {(n, *map(int, i)): x for n, v in planes.items() for i, x in np.ndenumerate(v[:, ::-1] if flipped else v) if x != -9999}
    line = 11 * np.dtype(dtype).itemsize
    for split in (1, line, 5 * line, 100 * line):
        assert key(grids.read_grid(spark, f"{tmp_path}/*.bin", g, split=split)) == key(want)
    cut = grids.read_grid(spark, f"{tmp_path}/*.bin", g, window=(4, 9, 2, 8), bands=[2, 0], split=2 * line)
    assert key(cut) == key(want.where("row >= 4 and row < 9 and col >= 2 and col < 8 and band in (0, 2)"))
    kept = grids.read_grid(spark, f"{tmp_path}/a.bin", g, True, bands=[1], split=3 * line)
    assert kept.count() == 17 * 11 and kept.where("value is null").count() == int((planes["a"][1] == -9999).sum())
    assert grids.read_grid(spark, f"{tmp_path}/a.bin", g, bands=[], split=line).count() == 0
    for bad in ({"window": (0, 18, 0, 3)}, {"window": (3, 3, 0, 3)}, {"bands": [3]}):
        with pytest.raises(ValueError):
            grids.read_grid(spark, f"{tmp_path}/a.bin", g, **bad)


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    """Holes but for a few cells; many tasks read it."""
    rows, cols = 20_000, 32_000
    path = tmp_path / "big.bin"
    cells = {(0, 0): 1.0, (9_999, 17): 2.5, (rows - 1, cols - 1): 7.0}
    with open(path, "wb") as f:
        f.truncate(rows * cols * 4)
        for (i, j), v in cells.items():
            f.seek((i * cols + j) * 4)
            f.write(np.float32(v).tobytes())
    g = grids.Grid(1, rows, cols, 0, 0, 1, -1, 0.0, False)
    got = grids.read_grid(spark, str(path), g)
    assert path.stat().st_size > 2**31 and got.rdd.getNumPartitions() > 200
    assert {(x.row, x.col): x.value for x in got.collect()} == cells
    part = grids.read_grid(spark, str(path), g, window=(9_990, 10_010, 10, 20))
    assert part.rdd.getNumPartitions() == 1 and [(x.row, x.col, x.value) for x in part.collect()] == [(9_999, 17, 2.5)]


def test_many_ranges_share_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k:02d}.bin").write_bytes(np.full(12, k, "<f4").tobytes())
    got = grids.read_grid(spark, f"{tmp_path}/*.bin", grids.Grid(1, 4, 3, 0, 0, 1, -1), split=12)
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and got.count() == 360


def test_short_files_raise(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(99))
    with pytest.raises(ValueError, match="ends before"):
        store.get_range(f"{tmp_path}/a.bin", 90, 10)
    g = grids.Grid(1, 5, 5, 0, 0, 1, -1)
    for split in (10, 1000):
        with pytest.raises(Exception):
            grids.read_grid(spark, f"{tmp_path}/a.bin", g, split=split).select(F.sum("value")).collect()


def test_pcraster_by_ranges(spark, tmp_path):
    r = np.random.default_rng(8)
    v = np.where(r.random((37, 9)) < 0.2, np.nan, r.integers(0, 50, (37, 9)).astype(float))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.map").write_bytes(rasters.encode_pcraster(v, 3.0, 8.0, 0.5))
    want = {(i, j): (3 + (j + 0.5) * 0.5, 8 - (i + 0.5) * 0.5, x) for (i, j), x in np.ndenumerate(v) if x == x}
    show = lambda df: {(x.row, x.col): (x.lon, x.lat, x.value) for x in df.collect()}
    for split in (36, 100, 10**6):
        assert show(rasters.read_pcraster(spark, f"{tmp_path}/one", split=split)) == want
    cut = rasters.read_pcraster(spark, f"{tmp_path}/one", (30, 60, 2, 5), 72)
    assert show(cut) == {k: x for k, x in want.items() if k[0] >= 30 and 2 <= k[1] < 5} and show(rasters.read_pcraster(spark, f"{tmp_path}/one", (40, 60, 2, 5))) == {}
    cells = spark.createDataFrame([(i, j, float(x[2])) for (i, j), x in want.items()], "row int, col int, value double")
    assert arrays.write_pcraster(cells, f"{tmp_path}/many", 37, 9, 3.0, 8.0, 0.5, 10) == 4
    assert {(x.lon, x.lat): x.value for x in rasters.read_pcraster(spark, f"{tmp_path}/many").collect()} == {x[:2]: x[2] for x in want.values()}


def test_planes_of_next_cells_in_several_files(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.bin").write_bytes(np.arange(24, dtype="<i4").tobytes() if n else (100 + np.arange(24, dtype="<i4")).tobytes())
    for split in (1, 16, 1000):
        got = {(x.file[-5], x.row, x.col): (x.nextx, x.nexty) for x in grids.read_next_xy(spark, f"{tmp_path}/*.bin", 3, 4, split).collect()}
        assert got == {(str(n), i, j): (100 * (1 - n) + 4 * i + j, 100 * (1 - n) + 12 + 4 * i + j) for n in range(2) for i in range(3) for j in range(4)}


def jobs_of(spark, group, f):
    """What f gives, and the tasks of each stage that it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        got = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    t = sc.statusTracker()
    stages = [t.getStageInfo(s) for j in t.getJobIdsForGroup(group) for s in t.getJobInfo(j).stageIds]
    return got, [s.numTasks for s in stages if s]


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"{k:03d}.bin").write_bytes(np.full(6, k, "<i4").tobytes())
    before = spark.conf.get(grids._LISTERS)
    got, tasks = jobs_of(spark, "listing", lambda: grids.binary_files(spark, f"{tmp_path}/*.bin").count())
    assert got == 150 and tasks and max(tasks) < 100 and spark.conf.get(grids._LISTERS) == before


def test_planes_are_read_without_a_shuffle_of_cells(spark, tmp_path):
    """Each file is opened once for both planes, and no cells are grouped."""
    for k in range(20):
        (tmp_path / f"{k:02d}.bin").write_bytes(np.arange(48, dtype="<i4").tobytes())
    got = grids.read_next_xy(spark, f"{tmp_path}/*.bin", 6, 4, 16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, got.collect())) == sorted((f"file:{tmp_path}/{k:02d}.bin", i, j, 4 * i + j, 24 + 4 * i + j) for k in range(20) for i in range(6) for j in range(4))


def test_rows_are_written_in_order_by_tasks_of_many_files(spark, tmp_path):
    """Files that lie across frames, rows without cells, nulls, NaN, whole numbers beyond a double's, and rows outside of the grid."""
    r = np.random.default_rng(4)
    want = np.full((103, 5), -9999, "<i8")
    at = [(i, j) for i in range(103) for j in range(5) if r.random() < 0.7 and not 40 <= i < 52]
    for n, (i, j) in enumerate(at):
        want[i, j] = 2**53 + 2 * n + 1
    rows = [(i, j, int(want[i, j])) for i, j in at] + [(45, 0, None), (-1, 0, 5), (104, 0, 5), (None, 0, 5)]
    cells = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "row int, col int, value long")
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert arrays.write_binary(cells, f"{tmp_path}/a", 103, 5, 4, dtype="<i8") == 26
        nan = cells.where("value is not null and row between 0 and 102").select("row", "col", F.when(F.col("row") < 8, float("nan")).otherwise(F.col("row")).alias("value"))
        assert arrays.write_binary(nan, f"{tmp_path}/b", 103, 5, 4) == 26
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
    read = lambda d, t: np.concatenate([np.frombuffer(p.read_bytes(), t) for p in sorted((tmp_path / d).iterdir())]).reshape(103, 5)
    assert (read("a", "<i8") == want).all()
    b, (i, _) = read("b", "<f4"), np.indices((103, 5))
    known = (want != -9999) & (i >= 8)
    assert (b[known] == i[known]).all() and (b[~known] == -9999).all()
    assert arrays.write_binary(cells.limit(0), f"{tmp_path}/c", 9, 5, 4) == 3 and sum(p.stat().st_size for p in (tmp_path / "c").iterdir()) == 180
