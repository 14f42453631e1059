"""The jobs of the folder jobs/: reruns, growing input, odd rows, the command line's settings."""

import logging
from datetime import date

import pytest
from floodstats.operators import extremes, series
from jobs import design_levels, report_catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_levels_twice(spark, tmp_path, caplog):
    before = dict(spark.conf.getAll)
    with caplog.at_level(logging.INFO):
        first = rows(design_levels.run(spark, SF, str(tmp_path / "out")))
    again = design_levels.run(spark, SF, str(tmp_path / "out"))
    assert rows(again) == first and first and dict(spark.conf.getAll) == before
    assert f"read {spark.read.parquet(f'{SF}/orders.parquet').count()} values" in caplog.text and "wrote" in caplog.text
    years = {p.name for p in (tmp_path / "out/maxima").iterdir() if p.is_dir()}
    a, b = spark.read.parquet(f"{SF}/orders.parquet").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    days = {y: (min(b, date(y, 12, 31)) - max(a, date(y, 1, 1))).days + 1 for y in range(a.year, b.year + 1)}
    assert years == {f"year={y}" for y, n in days.items() if n > 0.9 * 366}
    x = design_levels.daily(spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/customer.parquet"))
    am = series.annual_max(series.drop_incomplete_years(x, ["station"], 0.9, "day"), ["station"], "day", "x", 14)
    want = extremes.return_levels(am, ["station"], [100.0], "am").select("station", F.round("level", 3).alias("v"))
    assert rows(again.where("kind = 'level' and at = 100").select("station", F.round("value", 3).alias("v"))) == rows(want)


REPORTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def batches(spark):
    one = [(i, " ".join(["word"] * (i % 37)), "en" if i % 3 else None, f"s{i % 4}", 0) for i in range(300)]
    two = [(i, "a b\tc\nd" * (i % 11), "de", f"s{i % 5}" if i % 7 else "", 0) for i in range(300, 700)]
    odd = [(None, None, None, None, None), (None, "x", "en", "s1", 1), (699, "twice", "en", "s2", 5), (699, "twice", "en", "s2", 5)]
    return [spark.createDataFrame(b, REPORTS) for b in (one, two, odd)]


def test_catalogue_of_growing_input(spark, tmp_path, batches, caplog):
    inbox, out, c = str(tmp_path / "in"), str(tmp_path / "out"), {"block": 50, "periods": [2, 10], "files_per_batch": 2}
    seen = []
    for b in batches:
        b.repartition(3).write.mode("append").parquet(inbox)
        caplog.clear()
        with caplog.at_level(logging.INFO):
            got = rows(report_catalogue.run(spark, inbox, out, c))
        assert f"read {b.count()} new reports" in caplog.text  # and none of those before
        seen.append(got)
    whole = batches[0].unionAll(batches[1]).unionAll(batches[2])
    want = report_catalogue.catalogue(report_catalogue.sums(whole, 50), 50, [2.0, 10.0])
    assert seen[-1] == rows(want) and seen[0] != seen[1]
    assert rows(report_catalogue.run(spark, inbox, out, c)) == seen[-1]  # nothing new
    by = {r.source: r for r in want.where("period = 2 or period is null").collect()}
    assert by["unnamed"].empty == 1 + sum(i % 77 == 0 for i in range(300, 700)) and by["unnamed"].reports == 1 + sum(i % 7 == 0 for i in range(300, 700)) and by["s1"].languages == 3
    assert sum(r.reports for r in by.values()) == 704


def test_catalogue_from_the_start_gives_the_same(spark, tmp_path, batches):
    inbox, c = str(tmp_path / "in"), {"block": 50, "periods": [2], "files_per_batch": 1}
    batches[0].unionAll(batches[1]).repartition(4).write.parquet(inbox)
    a, b = (rows(report_catalogue.run(spark, inbox, str(tmp_path / n), c | {"files_per_batch": k})) for n, k in (("a", 1), ("b", 100)))
    assert a == b


def test_a_batch_that_runs_again_writes_over(spark, tmp_path, batches):
    inbox, out, c = str(tmp_path / "in"), tmp_path / "out", {"block": 50, "periods": [2], "files_per_batch": 100}
    batches[0].write.parquet(inbox)
    first = rows(report_catalogue.run(spark, inbox, str(out), c))
    for f in (out / "checkpoint/commits").glob("*0*"):  # as if the run had ended before it noted the batch as done
        f.unlink()
    assert rows(report_catalogue.run(spark, inbox, str(out), c)) == first


def test_lagging_source(spark):
    own = spark.createDataFrame([(10, "a", "en", "old"), (500, "b", "en", "new"), (None, "c", "en", "none")], "doc_id long, text string, lang string, source string")
    got = {r.source: (r.lags, r.blocks) for r in report_catalogue.catalogue(report_catalogue.sums(own, 100), 100, [2.0]).collect()}
    assert got == {"old": (True, 1), "new": (False, 1), "none": (True, 0)}


def test_configurations():
    assert design_levels.read_config()["periods"] and report_catalogue.read_config()["block"] == 100
    for job in (design_levels, report_catalogue):
        with pytest.raises(SystemExit):
            job.main([])
