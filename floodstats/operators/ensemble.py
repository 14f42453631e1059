"""Votes and differences over ensemble members and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def append_mean(df: DataFrame, keys: list[str], member: str, columns: list[str], name: str = "mean") -> DataFrame:
    """The members' means as one more member; one aggregate over grouping sets."""
    cube = df.groupingSets([[*map(F.col, keys), F.col(member)], [*map(F.col, keys)]], *keys, member).agg(F.grouping(member).alias("_g"), *[F.avg(c).alias(c) for c in columns])
    return cube.select(*keys, F.when(F.col("_g") == 1, name).otherwise(F.col(member)).alias(member), *columns)


def majority(df: DataFrame, keys: list[str], member: str, flags: list[str]) -> DataFrame:
    """A flag holds if it does in at least half of the members, rounded up."""
    need = F.ceil(F.countDistinct(member) / 2)
    return df.groupBy(*keys).agg(*[(F.sum(F.col(f).cast("int")) >= need).alias(f) for f in flags])


def agreement(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Whether all members have the same sign."""
    return df.groupBy(*keys).agg((F.abs(F.sum(F.signum(x))) == F.count("*")).alias("agree"))


def separated(df: DataFrame, keys: list[str], member: str, side: str, a: str, b: str, low: str, high: str) -> DataFrame:
    """(keys, significant): in every member, the lower bound of the side that lies higher is above the upper bound of the other."""
    pick = lambda v, c: F.max(F.when(F.col(side) == v, F.col(c)))
    m = df.groupBy(*keys, member).agg(pick(a, low).alias("al"), pick(a, high).alias("ah"), pick(b, low).alias("bl"), pick(b, high).alias("bh"))
    return m.groupBy(*keys).agg(F.bool_and((F.col("al") > F.col("bh")) | (F.col("bl") > F.col("ah"))).alias("significant"))


def difference(df: DataFrame, keys: list[str], scenario: str, a: str, b: str, x: str) -> DataFrame:
    """(keys, diff): a's value less b's, for keys with both; one aggregate instead of a self-join."""
    pick = lambda v: F.max(F.when(F.col(scenario) == v, F.col(x)))
    return df.groupBy(*keys).agg((pick(a) - pick(b)).alias("diff")).where("diff is not null")


def shares(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(keys, code, n, share): percent of each code among the rows of its keys."""
    from pyspark.sql import Window

    c = df.groupBy(*keys, code).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100)


def driver_class(df: DataFrame) -> DataFrame:
    """class of columns h, q (dominance of level and discharge): 1 h alone, 2 q alone, 3 both, 4 neither."""
    return df.withColumn("class", F.when(F.col("h") & F.col("q"), 3).when(F.col("h"), 1).when(F.col("q"), 2).otherwise(4).cast("long"))


def wide(df: DataFrame, keys: list[str], column: str, names: list[str], x: str) -> DataFrame:
    """One column for each named member (means); names given, so no pass over the data to find them."""
    return df.groupBy(*keys).pivot(column, names).agg(F.avg(x))


def long(df: DataFrame, keys: list[str], names: list[str], column: str, x: str) -> DataFrame:
    return df.unpivot(keys, names, column, x)
