"""Tables from files: delimited and white-space text, one file per year, and checks of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """With a header and a declared schema, so that no pass over the data infers it."""
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding, sep=sep)


def read_words(spark: SparkSession, path: str, columns: dict[str, str], skip: int = 0) -> DataFrame:
    """Columns (name: type) of white-space separated text, after skip lines of each file, which must then be one partition."""
    lines = spark.read.text(path, wholetext=bool(skip))
    if skip:
        lines = lines.select(F.explode(F.slice(F.split("value", "\r?\n"), skip + 1, 2**31 - 1 - skip)).alias("value"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(*[F.get(parts, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())])


def read_transposed(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """White-space text whose rows are the columns: a name, then one value for each record. Meant for small region lists."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w"))
    long = rows.select(F.get("w", 0).alias("name"), F.posexplode(F.slice("w", 2, 2**31 - 3)).alias("i", "v"))
    wide = long.groupBy("i").pivot("name", list(columns)).agg(F.first("v"))
    return wide.select("i", *[F.col(n).try_cast(k).alias(n) for n, k in columns.items()]).orderBy("i").drop("i")


def newest_by_file(df: DataFrame, t: str, expected_year: int) -> DataFrame:
    """(file, newest) of the files whose newest time is not in the expected year. df: straight from a reader."""
    return df.select(F.input_file_name().alias("file"), t).groupBy("file").agg(F.max(t).alias("newest")).where(F.year("newest") != expected_year)


def days_since(offset, origin: str):
    """CF times: days since an origin, to a timestamp."""
    return F.timestamp_micros((F.unix_micros(F.lit(origin).cast("timestamp")) + F.round(offset * 86_400_000_000)).cast("long"))
