"""Extraction from gridded files: nearest of the real coordinates, times of several units, several variables, attributes of points."""

from datetime import datetime

import pytest
from floodstats.plans import commands
from floodstats.sources import arrays, rasters
from pyspark.sql import functions as F


def grid(spark, lons, lats, times=(0.0,)):
    rows = [(t, y, x, 1000 * t + 10 * y + x) for t in times for y in lats for x in lons]
    return spark.createDataFrame(rows, "time double, lat double, lon double, value double")


def test_nearest_on_irregular_axes(spark):
    cells = grid(spark, [0.0, 1.0, 2.0, 10.0], [5.0, 4.0, 0.0])
    points = spark.createDataFrame([(1, 0.0, 4.0), (2, 6.0, 4.4), (3, 6.1, 2.0), (4, -0.6, 4.0), (5, 13.9, 5.4), (6, 14.1, 5.0), (7, 0.5, 4.0), (8, None, 4.0)], "index int, lon double, lat double")
    got = {r["index"]: r.value for r in commands.extract_points(cells, points).collect()}
    assert got == {1: 40.0, 2: 50.0, 3: 50.0, 5: 60.0, 7: 41.0}  # 2 and 3 lie midway and take the greater, 4, 6 and 8 are off the grid


def test_axes_are_checked(spark, monkeypatch):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "index int, lon double, lat double")
    with pytest.raises(ValueError, match="no cells"):
        commands.extract_points(grid(spark, [], [1.0]), points)
    monkeypatch.setattr(commands, "MOST_VALUES", 2)
    with pytest.raises(ValueError, match="no axis"):
        commands.extract_points(grid(spark, [1.0, 2.0, 3.0], [1.0]), points)


def test_long_axes_and_many_points(spark):
    """More values than an axis used to have: points find theirs by order, not by holding themselves against each value."""
    cells = spark.range(120_001).select((F.col("id") * 0.5).alias("lat"), F.lit(3.0).alias("lon"), F.col("id").cast("double").alias("value"))
    points = spark.range(3000).select(F.col("id").alias("index"), F.lit(3.2).alias("lon"), (F.col("id") * 20.25 - 0.3).alias("lat"))
    got = {r["index"]: r.value for r in commands.extract_points(cells, points).collect()}
    want = {i: float(min(range(max(0, k := int((20.25 * i - 0.3) * 2) - 2), k + 4), key=lambda j: (abs(j * 0.5 - (20.25 * i - 0.3)), -j))) for i in range(3000) if -0.25 <= 20.25 * i - 0.3 <= 60_000.25}
    assert len(got) > 2900 and got == want


def test_files_that_count_from_different_times(spark, tmp_path):
    for year, unit in ((2000, "days since 2000-01-01"), (2001, "hours since 2001-01-01")):
        own = grid(spark, [0.0, 1.0], [0.0, 1.0], (0.0, 24.0)).withColumn("year", F.lit(year))
        arrays.write_netcdf(own, f"{tmp_path}/{year}", "level", ["time", "lat", "lon"], "year", coord_attributes={"time": {"units": unit}})
    got = commands.gridded(spark, f"{tmp_path}/*/*.nc", "level", ["time", "lat", "lon"], "time")
    assert {r.time for r in got.select("time").distinct().collect()} == {datetime(2000, 1, 1), datetime(2000, 1, 25), datetime(2001, 1, 1), datetime(2001, 1, 2)}
    with pytest.raises(Exception, match="no variable"):
        commands.gridded(spark, f"{tmp_path}/*/*.nc", "none", ["time", "lat", "lon"]).collect()


def test_units_take_a_row_of_each_file(spark, tmp_path):
    """Not one of each cell; a file without values says nothing, one without units is an error."""
    for year, unit in ((2000, "days since 2000-01-01"), (2001, None), (2002, None)):
        own = grid(spark, [float(k) for k in range(20)], [float(k) for k in range(20)], (0.0, 1.0)).withColumn("year", F.lit(year)).withColumn("value", F.lit(-9999.0) if year == 2001 else F.col("value"))
        arrays.write_netcdf(own, f"{tmp_path}/{year}", "level", ["time", "lat", "lon"], "year", coord_attributes={"time": {"units": unit} if unit else {}})
    files = "{2000,2001}/*.nc"
    units = rasters.netcdf_units(spark, f"{tmp_path}/{files}", "level", "time").collect()
    assert [(r.file[-12:], r.units, r.calendar) for r in units] == [("year=2000.nc", "days since 2000-01-01", None)]
    got = commands.gridded(spark, f"{tmp_path}/{files}", "level", ["time", "lat", "lon"], "time")
    assert got.count() == 800 and {r.time for r in got.select("time").distinct().collect()} == {datetime(2000, 1, 1), datetime(2000, 1, 2)}
    with pytest.raises(ValueError, match="no units"):
        commands.gridded(spark, f"{tmp_path}/*/*.nc", "level", ["time", "lat", "lon"], "time")


def test_several_variables_and_attributes(spark, tmp_path):
    own = grid(spark, [0.0, 1.0, 5.0], [0.0, 1.0], (0.0, 1.0))
    shape = {"time": 2, "lat": 2, "lon": 3}
    place = own.select(F.col("time").cast("int").alias("time"), F.col("lat").cast("int").alias("lat"), F.when(F.col("lon") > 1, 2).otherwise(F.col("lon")).cast("int").alias("lon"), "value")
    lines = {"time": [0.0, 1.0], "lat": [0.0, 1.0], "lon": [0.0, 1.0, 5.0]}
    path = f"{tmp_path}/g.zarr"
    arrays.write_zarr(place, path, "q", shape, [1, 2, 2], lines)
    arrays.write_zarr(place.withColumn("value", -F.col("value")), path, "h", shape, [1, 2, 2], lines)
    (tmp_path / "p.csv").write_text("index,lon,lat,name\n7,4.5,0.9,mouth\n8,0.1,0.1,bay\n")
    commands.extract(spark, path, f"{tmp_path}/p.csv", f"{tmp_path}/out", ["q", "h"], ["time", "lat", "lon"], keep_attributes=True)
    got = {(r["index"], r.time): (r.q, r.h, r.name, r.lon) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(7, 0.0): (15.0, -15.0, "mouth", "4.5"), (7, 1.0): (1015.0, -1015.0, "mouth", "4.5"), (8, 0.0): (0.0, 0.0, "bay", "0.1"), (8, 1.0): (1000.0, -1000.0, "bay", "0.1")}
