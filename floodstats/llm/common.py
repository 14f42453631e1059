"""What the operators of this subpackage share: reading, the shared folder, Arrow helpers, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..functions.ship import ship

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scopes: list[list[str]] = []


#: Spark's setting under which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, packed: bool = False, free: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts the lineage and any claim to a partitioning.

    An executor's loss after this costs no more than reading the table again. What is returned may be read at any later time, so
    the table stays, in the application's own folder there, unless it is made within `scratch`. packed: its large values are compressed
    already, and are not to be again: a page holds a hundred rows at least, and both ways need buffers of a page outside the heap.
    free: what the write shuffled leaves the disk at its end.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true" if free else before)
    try:
        (df.write.option("compression", "none") if packed else df.write).parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stashed within are deleted at its end, but for those whose paths are taken out of the list that it gives."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        delete(spark, own)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch hold texts here, and both sides keep whole batches: 10,000 by default, 1,000 at most from now on.
    Spark reads the setting when it runs a plan, so it can't be bound to one; README names it."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast; one that df lacks is null. Extra columns of any name never reach the operators."""
    small_batches(df.sparkSession)
    have = set(df.columns)
    return df.select(*[(df[f"`{c}`"].cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def free_prefix(df: DataFrame) -> str:
    """A prefix for own columns that none of df's names begins with, in any case."""
    p = "_own_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes of edges (a long, b long); component: the smallest node reachable.

    Alternates large and small stars until a round changes no row; every node then points at its component's smallest node.
    A round's edges and the least neighbours go to the shared folder, so a node with very many links is a large partition of
    two plain exchanges, which adaptive execution splits. Only counts come to the driver.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        with scratch(spark) as own:
            out = stash(df)
            paths.append(own.pop())
        return out

    e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = e.count()
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = kept(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, n = n, new.count()
        settled = n == before and new.join(e, ["a", "b"], "left_anti").isEmpty()
        e = new
        delete(spark, paths[:-1])
        del paths[:-1]
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if _scopes:
        _scopes[-1].append(paths[0])
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
