"""Sources, sinks, streams and plans."""

import json
import re

import numpy as np
import pytest
from floodstats.operators import series as S
from floodstats.plans.data import daily
from floodstats.sources import config, grids, sinks, tables
from floodstats.streaming import resample as stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1]}')
    (tmp_path / "a.ini").write_text("[Main]\nKey = v ; comment\n")
    (tmp_path / "a.nam").write_text('&NRUN\nLOK = .TRUE. ! yes\nX=1.5d0,\nN=3\nF = "a!b"\n/\n')
    assert config.read_json(f"{tmp_path}/a.json") == {"a": [1]} and config.read_ini(f"{tmp_path}/a.ini") == {"Main": {"Key": "v"}}
    got = config.read_namelist(f"{tmp_path}/a.nam")
    assert got == {"nrun": {"lok": True, "x": 1.5, "n": 3, "f": "a!b"}}
    (tmp_path / "b.nam").write_text(config.write_namelist(got))
    assert config.read_namelist(f"{tmp_path}/b.nam") == got


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,caf\xe9\n", encoding="latin-1")
    assert tables.read_csv(spark, f"{tmp_path}/a.csv", "id int, name string", "ISO-8859-1").collect() == [(1, "caf\xe9")]
    (tmp_path / "w.txt").write_text("head\n  1   2.5 \n\n 3 x\n")
    assert tables.read_words(spark, f"{tmp_path}/w.txt", {"a": "int", "b": "double"}, skip=1).collect() == [(1, 2.5), (3, None)]
    (tmp_path / "t.txt").write_text("area  as1 eu1\nny 100 200\nwest -10 5.5\n")
    assert tables.read_transposed(spark, f"{tmp_path}/t.txt", {"area": "string", "ny": "int", "west": "double"}).collect() == [("as1", 100, -10.0), ("eu1", 200, 5.5)]


def test_newest_by_file(spark, tmp_path):
    for y in (1999, 2000):
        spark.sql(f"SELECT timestamp '{y}-05-01' AS t").coalesce(1).write.parquet(f"{tmp_path}/y={y}")
    got = tables.newest_by_file(spark.read.parquet(str(tmp_path)), "t", 2000).collect()
    assert len(got) == 1 and "y=1999" in got[0].file
    days = spark.range(1).select(tables.days_since(F.lit(1.5), "1980-01-01").alias("t")).first().t
    assert str(days) == "1980-01-02 12:00:00"


def test_binary_grid(spark, tmp_path):
    v = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    v[0, 1, 2] = -9999
    (tmp_path / "g.bin").write_bytes(v.tobytes())
    (tmp_path / "g.ctl").write_text("DSET ^g.bin\nUNDEF -9999\nTITLE t\nOPTIONS little_endian\nXDEF 4 LINEAR 0.125 0.25\nYDEF 3 LINEAR -0.375 0.25\nZDEF 1 LEVELS 0\nTDEF 2 LINEAR 00Z01jan2000 1dy\nVARS 1\nq 0 99 flow\nENDVARS\n")
    g = grids.read_control(f"{tmp_path}/g.ctl")
    assert (g.bands, g.rows, g.cols, g.west, g.north, g.dx, g.dy) == (2, 3, 4, 0.0, 0.25, 0.25, -0.25) and g.flipped
    got = {(r.band, r.row, r.col): r.value for r in grids.read_grid(spark, g.file, g).collect()}
    assert len(got) == 23 and got[0, 0, 0] == 8 and got[1, 2, 3] == 15 and (0, 1, 2) not in got
    at = grids.located(grids.read_grid(spark, g.file, g), g).where("band = 0 and row = 0 and col = 0").first()
    assert (at.lon, at.lat) == (0.125, 0.125)
    with pytest.raises(ValueError):
        grids.clipped(grids.located(grids.read_grid(spark, g.file, g), g), 90, 10, 1000)
    (tmp_path / "n.bin").write_bytes(np.array([[[2, -9]], [[1, -9]]], "<i4").tobytes())
    assert {(r.col, r.nextx, r.nexty) for r in grids.read_next_xy(spark, f"{tmp_path}/n.bin", 1, 2).collect()} == {(0, 2, 1), (1, -9, -9)}
    cells = spark.createDataFrame([(0, 1, 2.0), (1, 0, None)], "row int, col int, value double")
    assert np.frombuffer(sinks.to_binary(cells, 2, 2), "<f4").tolist() == [-9999, 2, -9999, -9999]
    with pytest.raises(ValueError):
        sinks.to_binary(cells, 10_000, 10_000)


def test_sinks(spark, tmp_path):
    d = daily(spark, SF)
    sinks.write_by_year(sinks.provenance(sinks.described(d, {"x": {"unit": "m3/s"}}), "here", "made"), f"{tmp_path}/y")
    back = spark.read.parquet(f"{tmp_path}/y")
    assert back.count() == d.count() and back.schema["x"].metadata["unit"] == "m3/s" and back.schema["k"].metadata["institution"] == "here"
    plan = back.where("year = 1997")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    before = sorted(back.inputFiles())
    sinks.write_table(d, f"{tmp_path}/y", if_exists="ignore")
    assert sorted(spark.read.parquet(f"{tmp_path}/y").inputFiles()) == before and sinks.exists(spark, f"{tmp_path}/y")
    sinks.write_csv(spark.sql("SELECT 1 AS a, 0.1234567D AS b"), f"{tmp_path}/c")
    assert spark.read.text(f"{tmp_path}/c").where("value like '1%'").first().value == "1,0.123457"
    sinks.write_geojson(spark.sql("SELECT 5 AS id, 1.5D AS lon, 2D AS lat"), f"{tmp_path}/g")
    f = json.loads(spark.read.text(f"{tmp_path}/g").first().value)
    assert f == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"id": 5}}
    spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, value double").write.parquet(f"{tmp_path}/old")
    sinks.update_cells(spark, f"{tmp_path}/old", spark.createDataFrame([(0, 0, 9.0), (0, 1, None), (1, 1, 3.0)], "row int, col int, value double"), f"{tmp_path}/new")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/new").collect()} == {(0, 0, 9.0), (0, 1, 2.0), (1, 1, 3.0)}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("x"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = stream.resample(source, ["k"], how=("max", "count"), late="60 days").writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("days")) == key(stream.resample(e, ["k"], how=("max", "count")))


def test_peaks_and_maxima_shuffle_once(spark):
    d = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("x"))
    plan = S.annual_max(d, ["k"], min_dist=14)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    assert re.search("ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp(_ntz)?,o_orderpriority:string>", plan)
