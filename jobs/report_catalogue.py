"""Catalogue of the text reports of each source, kept up to date as files with new ones come in.

    python -m jobs.report_catalogue REPORTS OUT [--config jobs/report_catalogue.json]

Reports (doc_id, text, lang, source) are numbered. REPORTS is the folder that Parquet files come into, or a pattern of
paths. A file stream with a
checkpoint in OUT/checkpoint takes the files that no earlier run has taken, all that are there, and ends. Each of its batches leaves
sums by source, language and block of report numbers in a folder of its own, OUT/sums/batch=<n>, which a batch that runs again
writes over. From these sums alone, and no texts, OUT/catalogue is made anew, in folders by source: how many reports there are,
how many hold no word, their words, the newest, whether the source lags (its newest report is in an earlier block than
the newest of all), and how long a report to expect once in so many blocks, by a Gumbel fit to the blocks' longest ones.

OUT/checkpoint and OUT/sums belong together: a run without its checkpoint needs a new OUT.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from floodstats.operators import extremes
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
CONFIG = str(Path(__file__).with_suffix(".json"))
REPORT = "doc_id long, text string, lang string, source string"
SUMS = "source string, lang string, block long, reports long, empty long, words long, longest long, newest long"
CATALOGUE = "reports long, empty long, languages long, words long, longest long, newest long, lags boolean, blocks long, period double, expected double, source string"
UNNAMED = "unnamed"


def read_config(path: str = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def _block(number: Column | str, block: int) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return F.floor((n - F.pmod(n, F.lit(block))) / block)


def sums(reports: DataFrame, block: int) -> DataFrame:
    """SUMS of the reports. A null or empty source or language is UNNAMED; reports without a number are in block null."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNNAMED)).alias(c)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = reports.select(name("source"), name("lang"), _block("doc_id", block).alias("block"), "doc_id", words.alias("n"))
    return own.groupBy("source", "lang", "block").agg(F.count("*").alias("reports"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.max("doc_id").alias("newest"))


def catalogue(own: DataFrame, block: int, periods: list[float]) -> DataFrame:
    """CATALOGUE of SUMS."""
    total = own.groupBy("source").agg(F.sum("reports").alias("reports"), F.sum("empty").alias("empty"), F.count_distinct("lang").alias("languages"), F.sum("words").alias("words"), F.max("longest").alias("longest"), F.max("newest").alias("newest"), F.count_distinct("block").alias("blocks"))
    last = own.agg(_block(F.max("newest"), block).alias("last"))  # one row
    total = total.crossJoin(F.broadcast(last)).withColumn("lags", F.coalesce(_block("newest", block) < F.col("last"), F.lit(True))).drop("last")
    maxima = own.where("block is not null").groupBy("source", "block").agg(F.max("longest").cast("double").alias("x"))
    levels = extremes.return_levels(maxima, ["source"], periods).withColumnsRenamed({"T": "period", "level": "expected"})
    return total.join(levels, "source", "left")


def run(spark: SparkSession, reports: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes what is new in reports and gives the whole catalogue."""
    c = config or read_config()

    def leave(batch: DataFrame, n: int) -> None:
        sums(batch, c["block"]).write.mode("overwrite").parquet(f"{out}/sums/batch={n}")
        LOG.info("wrote batch %d to %s/sums", n, out)

    new = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(reports)
    query = new.writeStream.foreachBatch(leave).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d new reports of %s", sum(p.numInputRows for p in query.recentProgress), reports)
    own = spark.read.schema(f"{SUMS}, batch long").parquet(f"{out}/sums")
    catalogue(own, c["block"], [float(p) for p in c["periods"]]).repartition("source").write.mode("overwrite").partitionBy("source").parquet(f"{out}/catalogue")
    done = output(spark, out)
    LOG.info("wrote %d rows to %s/catalogue", done.count(), out)
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CATALOGUE).parquet(f"{out}/catalogue")


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="jobs.report_catalogue", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for a in ("reports", "out"):
        p.add_argument(a)
    p.add_argument("--config", default=CONFIG)
    own = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("report catalogue").getOrCreate()
    try:
        run(spark, own.reports, own.out, read_config(own.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
