"""Orders over series too long for a task: one key, or none, may hold the whole table.

Rows are dealt out by ranges of (keys, order), so a long series lies in many partitions, each of which knows how many rows of it lie
before. From there on a row has its place, and what needs neighbours works on blocks of places with a margin on either side. No task
holds a series; a task's share is a range of the sort, or a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from . import climate


def _meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a and the other columns of b, where the columns `on` are the same; nulls meet nulls."""
    other = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return a.join(other, [a[c].eqNullSafe(other[f"_r_{c}"]) for c in on], how).drop(*[f"_r_{c}" for c in on])


def _dealt(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df in ranges of (keys, order), with _p, the range's number."""
    shared_dir(df.sparkSession)
    return df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()).checkpoint()


def placed(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "_i") -> DataFrame:
    """Adds out, each row's place (from 0) in its series, and <out>_n, the series' rows. The dealt rows go to the checkpoint folder, so
    that they lie as they do however often they are read."""
    dealt = _dealt(df, keys, order)
    n = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))  # a row for each key of each partition
    w = Window.partitionBy(*keys)
    n = n.select(*keys, "_p", F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias(f"{out}_n"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)) - 1)
    return _meet(own, n, [*keys, "_p"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def rank(df: DataFrame, keys: list[str], x: str = "x", method: str = "average", out: str = "rank") -> DataFrame:
    """`skill.rank` for any length: average, min, max or dense ranks from 1 of the values that aren't null, which have none."""
    own = placed(df.where(F.col(x).isNotNull()), keys, [x])
    same = own.groupBy(*keys, x).agg((F.min("_i") + 1).alias("_low"), (F.max("_i") + 1).alias("_high"))
    if method == "dense":
        same = placed(same.drop("_high"), keys, [x], "_d").withColumn("_r", F.col("_d") + 1)
    else:
        same = same.withColumn("_r", {"min": F.col("_low"), "max": F.col("_high"), "average": (F.col("_low") + F.col("_high")) / 2}[method])
    return _meet(df, same.select(*keys, x, F.col("_r").cast("double").alias(out)).where(F.col(x).isNotNull()), [*keys, x], "left")


def percentile(df: DataFrame, keys: list[str], q: list[float], x: str = "x", method: str = "linear") -> DataFrame:
    """`skill.percentile` for any length: (keys, q, value)."""
    own = placed(df.where(F.col(x).isNotNull()).select(*keys, x), keys, [x])
    at = own.withColumn("q", F.explode(F.array(*[F.lit(float(v)) for v in q]))).withColumn("_at", (F.col("_i_n") - 1) * F.col("q") / 100)
    near = at.where(F.col("_i").between(F.floor("_at"), F.ceil("_at")))  # two rows of each series
    pick = lambda k: F.max(F.when(F.col("_i") == k, F.col(x)))
    got = near.groupBy(*keys, "q").agg(pick(F.floor("_at")).alias("_l"), pick(F.ceil("_at")).alias("_h"), pick(F.bround("_at")).alias("_m"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    value = {"linear": F.col("_l") + F.col("_f") * (F.col("_h") - F.col("_l")), "lower": F.col("_l"), "higher": F.col("_h"), "nearest": F.col("_m"), "midpoint": (F.col("_l") + F.col("_h")) / 2}[method]
    return got.select(*keys, "q", value.alias("value"))


def above_kth(df: DataFrame, x: str, k: int) -> DataFrame:
    """`skill.above_kth` for any k: rows greater than the k-th greatest value; none where there are fewer values."""
    own = placed(df.where(F.col(x).isNotNull()), [], [x])
    cut = own.where(F.col("_i") == F.col("_i_n") - k).select(F.col(x).alias("_cut"))  # one row
    return own.drop("_i", "_i_n").join(F.broadcast(cut), F.col(x) > F.col("_cut")).drop("_cut")


def carried(df: DataFrame, keys: list[str], order: list[str], back: dict[str, str], ahead: dict[str, str]) -> DataFrame:
    """Adds columns to rows in their order: back maps a new column to the one whose last value that isn't null, up to the row, it takes;
    ahead to the one whose first from the row on. A range finds them in its own rows, else in a table of each range's last and first."""
    dealt = _dealt(df, keys, order)
    here = F.struct(*order)
    place = lambda c: F.when(F.col(c).isNotNull(), here)
    ends = dealt.groupBy(*keys, "_p").agg(*[F.max_by(c, place(c)).alias(f"_e_{o}") for o, c in back.items()], *[F.min_by(c, place(c)).alias(f"_e_{o}") for o, c in ahead.items()])
    w = Window.partitionBy(*keys)  # a row for each range that has rows of the key
    before, after = (w.orderBy(p).rowsBetween(Window.unboundedPreceding, -1) for p in ("_p", F.desc("_p")))
    ends = ends.select(*keys, "_p", *[F.last(f"_e_{o}", True).over(before if o in back else after).alias(f"_e_{o}") for o in (*back, *ahead)])
    w = Window.partitionBy("_p", *keys)
    up, down = (w.orderBy(*cs).rowsBetween(Window.unboundedPreceding, 0) for cs in (order, [F.desc(c) for c in order]))
    own = dealt.withColumns({o: F.last(c, True).over(up) for o, c in back.items()} | {o: F.last(c, True).over(down) for o, c in ahead.items()})
    return _meet(own, ends, [*keys, "_p"]).withColumns({o: F.coalesce(o, f"_e_{o}") for o in (*back, *ahead)}).drop("_p", *[f"_e_{o}" for o in (*back, *ahead)])


def to_grid(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """`climate.to_grid` for any length."""
    return climate.sided(carried(climate.both(anchors, grid, keys, t, x), keys, [t, "_g"], {"_a": "_here"}, {"_b": "_here"}), keys, t)


def interpolate_time(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """`climate.interpolate_time` for any length."""
    return climate.interpolate_time(anchors, grid, keys, t, x, to_grid)


def nearest_time(anchors: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", x: str = "x") -> DataFrame:
    """`climate.nearest_time` for any length."""
    return climate.nearest_time(anchors, grid, keys, t, x, to_grid)


def in_blocks(df: DataFrame, keys: list[str], order: list[Column | str], f: Callable[[DataFrame, list[str]], DataFrame], margin: int, rows: int = 1_000_000) -> DataFrame:
    """f(df, keys) where a row of its result depends on no row farther than `margin` places in its series: f is called with blocks as one
    more key, each with the margin of the blocks beside it, whose own rows are left out of the result. f must keep the columns it
    is given."""
    if not 0 <= margin < rows:
        raise ValueError("a block must be longer than the margin")
    own = placed(df, keys, order)
    at, b = F.col("_i") % rows, F.floor(F.col("_i") / rows)
    beside = F.filter(F.array(b, F.when(at < margin, b - 1), F.when(at >= rows - margin, b + 1)), lambda v: v >= 0)
    dealt = own.withColumns({"_home": b, "_b": F.explode(beside)})
    return f(dealt, [*keys, "_b"]).where("_b = _home").drop("_b", "_home", "_i", "_i_n")
