"""The Zarr data source: stores replaced whole or not at all, chunks left out by conditions, positions of several dimensions."""

import os

import numpy as np
import pytest
from floodstats.sources import arrays, rasters, store, zarr
from pyspark.sql import functions as F


def grid(spark, n, value=1.0):
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), (F.col("id") * 0 + value).cast("double").alias("value"))


def cells(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_a_smaller_store_takes_the_place_of_a_larger(spark, tmp_path):
    path = f"{tmp_path}/s.zarr"
    assert arrays.write_zarr(grid(spark, 8), path, "v", {"row": 8, "col": 8}, [3, 3], {"row": np.arange(8.0)}) == 9
    one = spark.createDataFrame([(5, 5, 2.0)], "row int, col int, value double")
    assert arrays.write_zarr(one, path, "v", {"row": 8, "col": 8}, [3, 3]) == 1
    assert cells(rasters.read_zarr(spark, path, "v")) == {(5, 5): 2.0}
    assert arrays.write_zarr(grid(spark, 4), path, "w", {"row": 4, "col": 4}, [4, 4]) == 1  # a variable beside it
    assert len(cells(rasters.read_zarr(spark, path, "w"))) == 16 and len(cells(rasters.read_zarr(spark, path, "v"))) == 1
    with pytest.raises(Exception, match="already"):
        arrays.write_zarr(one, path, "v", {"row": 8, "col": 8}, [3, 3], if_exists="append")
    assert not [n for n in os.listdir(path) if n.startswith(".") and n != ".zgroup"]


def test_a_failed_job_leaves_the_old_store(spark, tmp_path):
    path = f"{tmp_path}/s.zarr"
    arrays.write_zarr(grid(spark, 6), path, "v", {"row": 6, "col": 6}, [2, 2])
    outside = grid(spark, 6, 9.0).unionAll(spark.createDataFrame([(4, -1, 1.0)], "row int, col int, value double"))
    with pytest.raises(Exception):
        arrays.write_zarr(outside.withColumn("value", F.when(F.col("col") < 0, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("value"))), path, "v", {"row": 6, "col": 6}, [2, 2])
    assert set(cells(rasters.read_zarr(spark, path, "v")).values()) == {1.0} and len(store.names(f"{path}/v")) == 11
    assert not [n for n in os.listdir(path) if n.startswith(".") and n != ".zgroup"]


def test_conditions_leave_out_chunks(spark, tmp_path):
    path = f"{tmp_path}/s.zarr"
    df = grid(spark, 20).withColumn("value", F.col("row") * 100.0 + F.col("col"))
    arrays.write_zarr(df, path, "v", {"row": 20, "col": 20}, [5, 4], {"row": 50 - np.arange(20) * 0.5, "col": np.arange(20.0) * 10})
    whole = rasters.read_zarr(spark, path, "v", {"row": "row", "col": "col"})
    assert whole.columns == ["row", "col", "value", "row_value", "col_value"] and whole.rdd.getNumPartitions() == 20
    for how, parts in (("row = 7", 5), ("row >= 15 and col < 4", 1), ("col in (0, 19)", 8), ("row_value between 41 and 42", 5), ("row_value > 49 and col_value <= 30", 1), ("col_value = 35", 0), ("value > 0", 20), ("row = 3 or col = 3", 20)):
        own = whole.where(how)
        assert own.rdd.getNumPartitions() == parts or parts == 0, how
        want = df.selectExpr("*", "50 - row * 0.5 AS row_value", "col * 10.0 AS col_value").where(how)
        assert cells(own) == cells(want), how


def test_only_the_wanted_chunks_are_opened(spark, tmp_path):
    path = f"{tmp_path}/s.zarr"
    arrays.write_zarr(grid(spark, 20), path, "v", {"row": 20, "col": 20}, [5, 5])
    for name in os.listdir(f"{path}/v"):
        if name[0].isdigit() and name != "1.2":
            (tmp_path / "s.zarr" / "v" / name).write_bytes(b"no array")
    assert rasters.read_zarr(spark, path, "v").where("row between 5 and 9 and col between 10 and 14").count() == 25
    with pytest.raises(Exception):
        rasters.read_zarr(spark, path, "v").count()


def test_chunks_and_rows_of_any_order(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(int(t), int(y), int(x), float(v)) for (t, y, x), v in np.ndenumerate(r.normal(size=(7, 5, 6))) if v > -1] + [(0, 0, 0, None)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    df = spark.createDataFrame(rows, "time int, lat int, lon int, value double").repartition(3)
    n = arrays.write_zarr(df, f"{tmp_path}/s.zarr", "v", {"time": 7, "lat": 5, "lon": 6}, [3, 5, 4], attributes={"units": "m"})
    got = {(x.time, x.lat, x.lon): x.value for x in rasters.read_zarr(spark, f"{tmp_path}/s.zarr", "v").collect()}
    assert n == 6 and got == {x[:3]: x[3] for x in rows if x[3] is not None and not (x[:3] == (0, 0, 0) and x[3] is None)}


def test_writers_of_other_formats_leave_nothing_old(spark, tmp_path):
    big, one = grid(spark, 8), spark.createDataFrame([(0, 0, 2.0)], "row int, col int, value double")
    for df, n in ((big, 4), (one, 1)):
        assert arrays.write_geotiff_tiles(df, f"{tmp_path}/t", 0.0, 8.0, 1.0, 1.0, side=4) == n and len(os.listdir(tmp_path / "t")) == n
    for rows, n in ((8, 4), (2, 1)):
        assert arrays.write_binary(big.where(F.col("row") < rows), f"{tmp_path}/b", rows, 8, block=2) == n and len(os.listdir(tmp_path / "b")) == n
    for df, n in ((big, 8), (one, 1)):
        assert arrays.write_netcdf(df, f"{tmp_path}/n", "v", ["col"], "row") == n and len(os.listdir(tmp_path / "n")) == n


def test_source_by_name(spark, tmp_path):
    zarr.use(spark)
    arrays.write_zarr(grid(spark, 3), f"{tmp_path}/s.zarr", "v", {"row": 3, "col": 3}, [2, 2])
    assert spark.read.format("zarr").option("variable", "v").load(f"{tmp_path}/s.zarr").groupBy("row").count().count() == 3
