"""Grids from one set of cells to another: sparse tables of weights along each axis, applied by joins and a sum; and polygons to cells by
sweeping rows. Nothing meets pairwise: an axis' table has a few rows for each of its cells, and a polygon's run of cells is
found from where its edges cross a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Axis:
    """Cells of one size: the outer edge of the first, the step (negative: falling), and their number."""

    start: float
    step: float
    n: int

    def edge(self, i: Column) -> Column:
        return F.lit(self.start) + i * self.step

    def centre(self, i: Column) -> Column:
        return F.lit(self.start) + (i + 0.5) * self.step


def area_weights(spark: SparkSession, source: Axis, target: Axis, sphere: bool = False) -> DataFrame:
    """(src, dst, weight): what share of each source cell lies in each target cell. sphere: degrees of latitude, by the area between them."""
    on = (lambda v: F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), v))))) if sphere else (lambda v: v)
    s = spark.range(source.n).select(F.col("id").cast("int").alias("src"))
    low, high = (f(source.edge(F.col("src")), source.edge(F.col("src") + 1)) for f in (F.least, F.greatest))
    at = lambda v: (v - target.start) / target.step
    first, last = (F.greatest(F.lit(0), F.least(F.lit(target.n - 1), F.floor(f(at(low), at(high))))) for f in (F.least, F.greatest))
    s = s.withColumn("dst", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    a, b = target.edge(F.col("dst")), target.edge(F.col("dst") + 1)
    shared = F.greatest(F.lit(0.0), on(F.least(high, F.greatest(a, b))) - on(F.greatest(low, F.least(a, b))))
    return s.withColumn("weight", shared / (on(high) - on(low))).where("weight > 0")


def linear_weights(spark: SparkSession, source: Axis, target: Axis) -> DataFrame:
    """(src, dst, weight): each target centre between the two source centres around it; beyond the first and last their value."""
    t = spark.range(target.n).select(F.col("id").cast("int").alias("dst"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(source.n - 1.0), (target.centre(F.col("dst")) - source.start) / source.step - 0.5))
    t = t.withColumns({"_i": F.floor(at).cast("int"), "_f": at - F.floor(at)})
    pair = F.array(F.struct(F.col("_i").alias("src"), (1 - F.col("_f")).alias("weight")), F.struct((F.col("_i") + 1).alias("src"), F.col("_f").alias("weight")))
    return t.select("dst", F.inline(pair)).where("weight > 0").select("src", "dst", "weight")


def apply_weights(grid: DataFrame, rows: DataFrame, cols: DataFrame, mean: bool, keys: list[str] | None = None, x: str = "value") -> DataFrame:
    """(keys, row, col, value): sums of the cells (row, col, value) times both weights; mean: divided by the weights of the cells that have data."""
    r, c = (w.select(F.col("src").alias(n), F.col("dst").alias(f"_{n}"), F.col("weight").alias(f"_w{n}")) for w, n in ((rows, "row"), (cols, "col")))
    both = grid.where(F.col(x).isNotNull()).join(r, "row").join(c, "col")
    w = F.col("_wrow") * F.col("_wcol")
    total = F.sum(F.col(x) * w)
    return both.groupBy(*(keys or []), F.col("_row").alias("row"), F.col("_col").alias("col")).agg((total / F.sum(w) if mean else total).alias(x))


def regrid(grid: DataFrame, source: tuple[Axis, Axis], target: tuple[Axis, Axis], how: str = "sum", keys: list[str] | None = None, x: str = "value", sphere: bool = False) -> DataFrame:
    """The cells (keys, row, col, value) of the source (rows, columns) on the target. sum: amounts, shared out by area, so that their total stays
    where the target covers the source; mean: the mean by area; linear: bilinear between centres. Cells without data don't count."""
    spark = grid.sparkSession
    if how == "linear":
        return apply_weights(grid, linear_weights(spark, source[0], target[0]), linear_weights(spark, source[1], target[1]), True, keys, x)
    if how == "sum":
        return apply_weights(grid, area_weights(spark, source[0], target[0], sphere), area_weights(spark, source[1], target[1]), False, keys, x)
    # the share of a target cell that a source cell covers: what the target would give the source
    turned = lambda a, b, s: area_weights(spark, b, a, s).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return apply_weights(grid, turned(source[0], target[0], sphere), turned(source[1], target[1], False), True, keys, x)


def rasterise(edges: DataFrame, rows: Axis, cols: Axis, polygon: str = "zone") -> DataFrame:
    """(row, col, polygon): the cells whose centres lie in each polygon (edges polygon, x1, y1, x2, y2), by the even-odd rule, as
    `spatial.in_polygons` has it. Each edge sends where it crosses a row's middle; between an odd crossing and the next lie the
    polygon's cells of that row."""
    e = edges.where("y1 <> y2")
    at = lambda y: (y - rows.start) / rows.step - 0.5
    ends = [f(at(F.col("y1")), at(F.col("y2"))) for f in (F.least, F.greatest)]
    first, last = F.greatest(F.lit(0.0), F.floor(ends[0])), F.least(F.lit(rows.n - 1.0), F.ceil(ends[1]))
    met = e.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("_y", rows.centre(F.col("row")))
    met = met.where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))).withColumn("_x", (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    w = Window.partitionBy(polygon, "row").orderBy("_x")
    spans = met.withColumns({"_k": F.row_number().over(w), "_to": F.lead("_x").over(w)}).where("_k % 2 = 1 and _x < _to")
    col = lambda v: (v - cols.start) / cols.step - 0.5
    left, right = F.least(col(F.col("_x")), col(F.col("_to"))), F.greatest(col(F.col("_x")), col(F.col("_to")))
    a, b = F.greatest(F.lit(0.0), F.floor(left)), F.least(F.lit(cols.n - 1.0), F.ceil(right))
    cells = spans.where(a <= b).withColumn("col", F.explode(F.sequence(a.cast("int"), b.cast("int"))))
    centre = cols.centre(F.col("col"))
    return cells.where((centre >= F.col("_x")) & (centre < F.col("_to"))).select("row", "col", polygon)
