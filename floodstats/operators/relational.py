"""Alignment of labelled tables: joins, selections by label, stacking and set operations, as their array counterparts define them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join on the shared labels. Where the frames are aggregates of one table, one agg() is better."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "inner")


def align_exact(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that raises, when it runs, on labels of one side that the other lacks; one full join, no extra pass."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), on, "full")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    return both.where(F.when(bad, F.raise_error(F.lit("labels differ"))).otherwise(F.lit(True)).cast("boolean")).drop("_a", "_b")


def reindex(df: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """All labels of target, with nulls where df has none."""
    return target.join(df, on, "left")


def select_labels(df: DataFrame, labels: DataFrame, on: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows by a list of labels (on, ordinal): in its order, repeated as it repeats them; a missing label raises."""
    got = labels.join(df.withColumn("_hit", F.lit(1)), on, "left")
    ok = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no such label: "), F.col(on).cast("string")))).otherwise(F.lit(True)).cast("boolean")
    return got.where(ok).drop("_hit").orderBy(ordinal)


def overlap(df: DataFrame, keys: list[str], t: str, a: str, b: str) -> DataFrame:
    """Rows between the later first and the earlier last time at which both columns have values."""
    w = Window.partitionBy(*keys)
    end = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col(t))).over(w)
    return df.withColumns({"_a": F.greatest(end(F.min, a), end(F.min, b)), "_b": F.least(end(F.max, a), end(F.max, b))}).where(F.col(t).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def concat(frames: dict[str, DataFrame], dim: str) -> DataFrame:
    """One table with the frames' names as a new key."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(dim, F.lit(k)) for k, f in frames.items()])


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def unique_labels(df: DataFrame, on: list[str]) -> DataFrame:
    """df unchanged; raises, when it runs, if labels repeat."""
    n = F.count("*").over(Window.partitionBy(*on))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("labels repeat"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def last_of_each(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_i = 1").drop("_i")


def by_coords(frames: list[DataFrame], coords: list[str]) -> DataFrame:
    """Parts of a data set put together by their coordinates: tables with the same variables are appended, and those with others are
    aligned on the coords, which every result row has (null coords meet each other); a variable is null where it has no value. A
    coordinate that several tables of one variable hold must hold the same there: it raises, when it runs, where they differ."""
    kinds: dict[tuple[str, ...], DataFrame] = {}
    for f in frames:
        names = tuple(sorted(c for c in f.columns if c not in coords))
        own = f.select(*coords, *names)
        kinds[names] = kinds[names].unionByName(own) if names in kinds else own
    out = None
    for names, f in kinds.items():
        one = f.groupBy(*coords).agg(*[F.first(F.struct(*names)).alias("_v"), F.count_distinct(F.struct(*names)).alias("_n")]) if names else f.distinct()
        if names:
            same = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"values of {', '.join(names)} differ at one coordinate"))).otherwise(F.lit(True)).cast("boolean")
            one = one.where(same).select(*coords, "_v.*")
        if out is None:
            out = one
            continue
        left, right = out.withColumnsRenamed({c: f"_l_{c}" for c in coords}), one.withColumnsRenamed({c: f"_r_{c}" for c in coords})
        rest = [c for c in out.columns if c not in coords]
        both = left.join(right, [F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in coords], "full")
        out = both.select(*[F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in coords], *rest, *names)
    return out
