"""Nearest points by a tree whose cells are as small as the points are dense, for points that crowd in one place and any distance.

Cells are squares of longitude and latitude, or cubes around the unit sphere; each splits into halves along each side as long as it holds
more than `leaf` different places. All places of left points, each once, go down the tree together, a level a round: a cell that lies farther
from a place than the farthest corner of another of its cells is left out, since that one holds a point at least as near. Places then meet
those of the few cells that are left. So no task holds a crowded cell, and no distance has to be set beforehand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sphere_distance
from ..functions.shared import shared_dir

MOST_LEVELS = 24


def _axes(lon: Column, lat: Column, metric: str) -> list[Column]:
    """Coordinates from 0 to 1 (half open) whose straight distances order points as the metric does."""
    if metric == "degree":
        return [(lon + 720) / 1500, (lat + 720) / 1500]
    a, b = F.radians(lon), F.radians(lat)
    return [(F.cos(b) * F.cos(a) + 1) / 2.000001, (F.cos(b) * F.sin(a) + 1) / 2.000001, (F.sin(b) + 1) / 2.000001]


def distance(x: str, y: str, u: str, v: str, metric: str, digits: int | None = None) -> Column:
    """By what the points (x, y) and (u, v) are near: metres on the sphere, or squared degrees, rounded to `digits` if given."""
    if metric != "degree":
        return sphere_distance(F.col(x), F.col(y), F.col(u), F.col(v))
    d2 = F.pow(F.col(x) - F.col(u), F.lit(2.0)) + F.pow(F.col(y) - F.col(v), F.lit(2.0))
    return d2 if digits is None else F.round(d2, digits)


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def nearest_by_tree(left: DataFrame, right: DataFrame, lid: str = "id", rid: str = "id", lon: str = "lon", lat: str = "lat", metric: str = "sphere", prefix: str = "near_", leaf: int = 64, max_dist: float | None = None, digits: int | None = None) -> DataFrame:
    """Each left point with its nearest right point (the smallest id of several), its columns and the distance in metres: metric sphere, or
    degree, in which longitudes don't wrap. max_dist: metres beyond which there is none. digits: those of squared degrees that count,
    so that places equally far tie. Points without coordinates have none."""
    dims = 2 if metric == "degree" else 3
    xs, cell = [f"_x{i}" for i in range(dims)], [f"_c{i}" for i in range(dims)]
    rest = [c for c in right.columns if c not in (rid, lon, lat)]
    r = right.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    r = r.groupBy(F.col(lon).alias("_rlon"), F.col(lat).alias("_rlat")).agg(F.min(F.struct(F.col(rid).alias("_id"), *rest)).alias("_r"))
    r = _cut(r.select("_rlon", "_rlat", "_r", *[x.alias(n) for n, x in zip(xs, _axes(F.col("_rlon"), F.col("_rlat"), metric))]))
    n = r.count()
    l = left.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).alias("_llon"), F.col(lat).alias("_llat")).distinct()
    l = l.select("*", *[x.alias(f"_p{i}") for i, x in enumerate(_axes(F.col("_llon"), F.col("_llat"), metric))])
    levels = min(MOST_LEVELS, 6 + math.ceil(math.log2(max(1, n / leaf)) / (dims - 1))) if n > leaf else 0
    at = lambda x, level: F.floor(F.col(x) * F.pow(F.lit(2.0), level)).cast("long")
    every = r.select(*xs, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    cells = _cut(every.groupBy("_level", *[at(x, F.col("_level")).alias(c) for x, c in zip(xs, cell)]).agg(F.count("*").alias("_n")))
    inner = F.col("_n") > leaf
    side = F.pow(F.lit(2.0), -F.col("_level"))
    low = lambda i: F.col(f"_c{i}") * side
    gap = [F.greatest(low(i) - F.col(f"_p{i}"), F.col(f"_p{i}") - low(i) - side, F.lit(0.0)) for i in range(dims)]
    far = [F.greatest(F.abs(low(i) - F.col(f"_p{i}")), F.abs(low(i) + side - F.col(f"_p{i}"))) for i in range(dims)]
    square = lambda v: sum((x * x for x in v[1:]), v[0] * v[0])
    slack, more = 1 + 1e-12, 1e-15 + (0.0 if digits is None else 10.0**-digits / 1500**2)  # what rounding may make of equal distances

    def kept(front: DataFrame) -> DataFrame:
        w = F.min(square(far)).over(Window.partitionBy("_llon", "_llat"))
        return _cut(front.withColumn("_far", w).where(square(gap) <= F.col("_far") * slack + more).drop("_far"))

    front = l.crossJoin(F.broadcast(cells.where("_level = 0")))  # the one cell that holds all
    for level in range(levels):
        open_ = front.where(inner & (F.col("_level") == level))
        below = cells.where(F.col("_level") == level + 1).select(*[F.floor(F.col(c) / 2).cast("long").alias(c) for c in cell], F.struct("_level", *cell, "_n").alias("_child"))
        down = open_.drop("_level", "_n").join(below, cell).drop(*cell).select(*l.columns, "_child.*")
        front = kept(front.where(~inner | (F.col("_level") < level)).select(*l.columns, "_level", *cell, "_n").unionByName(down))
        if front.where(inner & (F.col("_level") == level + 1)).isEmpty():
            break
    # the level of each leaf that is left, so that a right point is sent to its own leaf only
    wanted = _cut(front.select("_level", *cell).distinct())
    sent = r.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({c: at(x, F.col("_level")) for x, c in zip(xs, cell)}).join(wanted, ["_level", *cell])
    met = front.join(sent, ["_level", *cell])
    by = distance("_llon", "_llat", "_rlon", "_rlat", metric, digits)
    best = met.groupBy("_llon", "_llat").agg(F.min(F.struct(by.alias("_by"), F.col("_r._id").alias("_id"), "_rlon", "_rlat", "_r")).alias("_b"))
    best = best.withColumn("_m", sphere_distance(F.col("_llon"), F.col("_llat"), F.col("_b._rlon"), F.col("_b._rlat")))
    if max_dist is not None:
        best = best.where(F.col("_m") <= max_dist)
    found = {f"{prefix}id": F.col("_b._id"), **{f"{prefix}{c}": F.col(f"_b._r.{c}") for c in rest}, f"{prefix}dist": F.col("_m")}
    out = best.select(F.col("_llon").alias(lon), F.col("_llat").alias(lat), *[v.alias(c) for c, v in found.items()])
    own = [lid, lon, lat, *[c for c in left.columns if c not in (lid, lon, lat)]]
    return left.join(out, [lon, lat], "left").select(*own, *found)
