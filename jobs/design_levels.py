"""Design levels of stations: yearly maxima of independent peaks, and the levels that a Gumbel fit exceeds once in so many years.

    python -m jobs.design_levels TABLES OUT [--config jobs/design_levels.json]

The values (o_custkey, o_orderdate, o_totalprice) are summed by day and station, the station of a customer being the nation; days
without one are 0, and years without enough days are left out. Written are OUT/maxima, in folders by year, and OUT/levels, in folders
by return period, so that a year or a period is read alone. A run writes both anew, so the same input gives the same output
however often it runs, and a run that was stopped is mended by the next.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from floodstats.functions.calendar import densify
from floodstats.operators import extremes, series
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
CONFIG = str(Path(__file__).with_suffix(".json"))


def read_config(path: str = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def daily(values: DataFrame, stations: DataFrame) -> DataFrame:
    """(station, day, x) without gaps. The values are summed by customer and day before they meet the stations."""
    own = values.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    who = stations.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station"))
    return densify(own.join(who, "o_custkey").groupBy("station", "day").agg(F.round(F.sum("x"), 2).alias("x")), ["station"], "day", {"x": 0.0})


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Reads tables/<name>.parquet and gives what it has written: (station, kind, at, value), at a year or a return period."""
    c = config or read_config()
    source = Observation("read")
    values = spark.read.parquet(f"{tables}/{c['values']}.parquet").select("o_custkey", "o_orderdate", "o_totalprice").observe(source, F.count("*").alias("rows"))
    stations = spark.read.parquet(f"{tables}/{c['stations']}.parquet")
    x = series.drop_incomplete_years(daily(values, stations), ["station"], c["share_of_year"], "day", "x", "x")
    maxima = series.annual_max(x, ["station"], "day", "x", c["days_apart"]).where("am is not null")
    maxima.repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{out}/maxima")
    LOG.info("read %d values of %s/%s.parquet", source.get["rows"], tables, c["values"])
    kept = spark.read.schema("station int, am double, year int").parquet(f"{out}/maxima")
    levels = extremes.return_levels(kept, ["station"], [float(p) for p in c["periods"]], "am")
    levels.withColumnRenamed("T", "period").repartition("period").write.mode("overwrite").partitionBy("period").parquet(f"{out}/levels")
    done = output(spark, out)
    for r in done.groupBy("kind").count().collect():
        LOG.info("wrote %d rows of %ss to %s", r["count"], r["kind"], out)
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    maxima = spark.read.schema("station int, am double, year int").parquet(f"{out}/maxima")
    levels = spark.read.schema("station int, level double, period double").parquet(f"{out}/levels")
    one = lambda df, kind, at, value: df.select("station", F.lit(kind).alias("kind"), F.col(at).cast("double").alias("at"), F.col(value).alias("value"))
    return one(maxima, "maximum", "year", "am").unionAll(one(levels, "level", "period", "level"))


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="jobs.design_levels", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for a in ("tables", "out"):
        p.add_argument(a)
    p.add_argument("--config", default=CONFIG)
    own = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("design levels").getOrCreate()
    try:
        run(spark, own.tables, own.out, read_config(own.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
