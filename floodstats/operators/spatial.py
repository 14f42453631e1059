"""Joins of points with points and grid cells, zonal sums, gauge snapping, neighbourhoods. Cells are rows (row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import gauge_distance, sphere_distance
from ..functions.shared import shared_dir
from .nearest import distance, nearest_by_tree


def _height(max_dist: float) -> float:
    """Height in degrees of tiles that span max_dist metres."""
    return math.degrees(max_dist / 6373000.0) * 1.001


def _width(band: Column, max_dist: float) -> Column:
    """Width in degrees that max_dist metres span at most between a point of a band of latitude and one a band away; 360 at the poles."""
    h, s = _height(max_dist), math.sin(min(math.pi / 2, max_dist / 6373000.0 / 2))
    top = F.least(F.lit(90.0), F.greatest(F.abs(band * h), F.abs((band + 1) * h)) + h)
    c = F.cos(F.radians(top))
    return F.when(c <= s * 1.001, F.lit(360.0)).otherwise(F.least(F.lit(360.0), F.degrees(2 * F.asin(F.lit(s) / c)) * 1.001))


def _wrapped(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def _tiled(df: DataFrame, lon: str, lat: str, max_dist: float) -> DataFrame:
    """Adds the tile (_tx, _ty) of each point. Tiles are as wide as max_dist at their own latitude."""
    band = F.floor(F.col(lat) / _height(max_dist)).cast("long")
    return df.withColumn("_ty", band).withColumn("_tx", F.floor(_wrapped(F.col(lon)) / _width(F.col("_ty"), max_dist)).cast("long"))


def _sent(df: DataFrame, lon: str, lat: str, max_dist: float) -> DataFrame:
    """Each point once for each tile (_tx, _ty) that has points within max_dist of it, across the antimeridian too."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    d = df.withColumn("_ty", F.explode(F.transform(near, lambda i: F.floor(F.col(lat) / _height(max_dist)).cast("long") + i))).withColumn("_w", _width(F.col("_ty"), max_dist))
    turns = F.filter(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda t: F.abs(_wrapped(F.col(lon)) + t) <= 180 + 2 * F.col("_w"))
    tiles = F.array_distinct(F.flatten(F.transform(turns, lambda t: F.transform(near, lambda i: F.floor((_wrapped(F.col(lon)) + t) / F.col("_w")).cast("long") + i))))
    return d.withColumn("_tx", F.explode(tiles)).drop("_w")


#: Pairs of places that tiles may bring together: for each left place, or in all; beyond, points go down a tree. And those that a task looks at.
MET_EACH, MET, MET_TASK = 64, 20_000_000, 1_000_000


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> int:
    """How many pairs a join on tiles makes."""
    count = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
    return int(count(left, "_a").join(count(right, "_b"), on).agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0)


def _in_parts(left: DataFrame, right: DataFrame, on: list[str], met: int) -> DataFrame:
    """The join on tiles that makes `met` pairs. Rows are few where pairs are many, so that their bytes alone would leave all in one task."""
    parts = max(1, math.ceil(met / MET_TASK))
    return left.repartition(parts, *on).join(right.repartition(parts, *on), on)


def nearest_points(left: DataFrame, right: DataFrame, max_dist: float, lid: str = "id", rid: str = "id", lon: str = "lon", lat: str = "lat", metric: str = "degree", prefix: str = "near_", digits: int | None = None) -> DataFrame:
    """Each left point with its nearest right point (least degrees, or least distance on the sphere), null beyond max_dist metres.

    Places are looked up once, however many points share them. Both sides are cut into tiles as wide as max_dist at their own latitude; a
    right place goes to the tiles around it, and the rest is an equi-join on tiles. Places of one tile would meet pairwise, so the pairs
    are counted first; tiles are dealt into as many parts as the pairs need, and where they are many the places go down a tree instead
    (`nearest.nearest_by_tree`), with the same result.
    On the sphere, points just across the antimeridian are seen too; in degrees longitudes don't wrap. In degrees a point may be
    nearest and yet beyond max_dist, away from the equator; a second join, of the left places whose match is that far in degrees, finds
    these. digits: those of squared degrees that count, so that points equally far tie, of which the one with the smallest id is taken.
    """
    rest = [c for c in right.columns if c not in (rid, lon, lat)]
    r = right.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    r = r.groupBy(F.col(lon).alias("_rlon"), F.col(lat).alias("_rlat")).agg(F.min(F.struct(F.col(rid).alias("_id"), *rest)).alias("_r"))
    l = left.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(lon).alias("_llon"), F.col(lat).alias("_llat")).distinct()
    own = [lid, *[c for c in left.columns if c != lid]]
    found = [f"{prefix}id", *[f"{prefix}{c}" for c in rest], f"{prefix}dist"]
    by_tree = lambda: nearest_by_tree(left, right, lid, rid, lon, lat, metric, prefix, 16, max_dist, digits).select(*own, *found)
    tiled, sent = _tiled(l, "_llon", "_llat", max_dist), _sent(r, "_rlon", "_rlat", max_dist)
    most = max(MET, MET_EACH * l.count())
    met = _met(tiled, sent, ["_tx", "_ty"])
    if met > most:
        return by_tree()
    both = _in_parts(tiled, sent, ["_tx", "_ty"], met)
    both = both.withColumn("_m", sphere_distance(F.col("_llon"), F.col("_llat"), F.col("_rlon"), F.col("_rlat"))).where(F.col("_m") <= max_dist)
    by = distance("_llon", "_llat", "_rlon", "_rlat", metric, digits)
    best = both.groupBy("_llon", "_llat").agg(F.min(F.struct(by.alias("_by"), F.col("_r._id").alias("_id"), F.col("_m").alias("_m"), "_r")).alias("_b"))
    if metric == "degree":
        far = best.where(F.col("_b._by") > (max_dist / 6373000.0 * 180 / math.pi) ** 2).select("_llon", "_llat", F.col("_b._by").alias("_by"), F.col("_b._id").alias("_id"))
        side = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt("_by"))).cast("double"))
        far = far.withColumn("_side", side)
        sides = [x[0] for x in far.select("_side").distinct().collect()]  # powers of two from max_dist to 360 degrees: a few
        if sides:
            near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
            cell = lambda c, s: F.floor(F.col(c) / s).cast("long")
            other = r.select(F.col("_r._id").alias("_rid"), "_rlon", "_rlat").withColumn("_side", F.explode(F.array(*map(F.lit, sides))))
            other = other.withColumn("_tx", F.explode(F.transform(near, lambda i: cell("_rlon", F.col("_side")) + i))).withColumn("_ty", F.explode(F.transform(near, lambda i: cell("_rlat", F.col("_side")) + i)))
            far = far.withColumns({"_tx": cell("_llon", F.col("_side")), "_ty": cell("_llat", F.col("_side"))})
            on = ["_side", "_tx", "_ty"]
            met = _met(far, other, on)
            if met > most:
                return by_tree()
            closer = _in_parts(far, other, on, met).where((by < F.col("_by")) | ((by == F.col("_by")) & (F.col("_rid") < F.col("_id"))))
            best = best.join(closer.select("_llon", "_llat").distinct(), ["_llon", "_llat"], "left_anti")
    best = best.select(F.col("_llon").alias(lon), F.col("_llat").alias(lat), F.col("_b._id").alias(found[0]), *[F.col(f"_b._r.{c}").alias(f"{prefix}{c}") for c in rest], F.col("_b._m").alias(found[-1]))
    return left.join(best, [lon, lat], "left").select(*own, *found)


def grid_at_points(grid: DataFrame, points: DataFrame, x0: float, y0: float, dx: float, dy: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with the columns of the nearest cell; (x0, y0): the centre of cell (0, 0). Points outside the grid get nulls."""
    p = points.withColumns({"row": F.round((F.col(lat) - y0) / dy).cast("int"), "col": F.round((F.col(lon) - x0) / dx).cast("int")})
    return p.join(grid, ["row", "col"], "left")


def raster_lookup(points: DataFrame, grid: DataFrame, x0: float, y0: float, dx: float, dy: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points with the columns of the cell they lie in; (x0, y0): the outer corner of cell (0, 0)."""
    p = points.withColumns({"row": F.floor((F.col(lat) - y0) / dy).cast("int"), "col": F.floor((F.col(lon) - x0) / dx).cast("int")})
    return p.join(grid, ["row", "col"], "left")


def zonal(grid: DataFrame, mask: DataFrame, how: str = "mean", keys: list[str] | None = None, x: str = "value") -> DataFrame:
    """(zone, keys, value): mean or sum over the cells of each zone of mask (row, col, zone); zone 0 is background."""
    f = {"mean": F.avg, "sum": F.sum}[how]
    return grid.join(mask.where("zone <> 0"), ["row", "col"]).groupBy("zone", *(keys or [])).agg(f(x).alias("value"))


def catchment_exposure(fine: DataFrame, coarse: DataFrame, low: float = 10.0) -> DataFrame:
    """(row, col, total, low_total): people of fine cells (catmx, catmy from 1, flddif, exp) by their catchment's cell; the
    second sum only where elevtn + flddif is under low in the coastal zone. Cells without catchment or people don't count."""
    f = fine.where("catmx > 0 and exp > 0").select((F.col("catmy") - 1).alias("row"), (F.col("catmx") - 1).alias("col"), "flddif", "exp")
    both = f.join(coarse.select("row", "col", "elevtn", "lecz"), ["row", "col"])
    under = (F.col("elevtn") + F.col("flddif") < low) & F.col("lecz")
    return both.groupBy("row", "col").agg(F.sum("exp").alias("total"), F.coalesce(F.sum(F.when(under, F.col("exp"))), F.lit(0.0)).alias("low_total"))


def mosaic_sum(*parts: DataFrame) -> DataFrame:
    """Sum of the parts' cells; null is no data and doesn't count."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("row", "col").agg(F.sum("value").alias("value"))


def mosaic_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of either; the new value where it has data, else the old one."""
    n = new.select("row", "col", F.col("value").alias("_new"))
    return old.join(n, ["row", "col"], "full").select("row", "col", F.coalesce("_new", "value").alias("value"))


def flood_depth(level: Column, ground: Column, missing: float = 1e20) -> Column:
    """Water above ground, 0 at least; missing where either is."""
    return F.when(level.isNull() | ground.isNull(), F.lit(missing)).otherwise(F.greatest(level - ground, F.lit(0.0)))


def exposed(people: Column, compound: Column, single: Column, least: float = 0.01) -> Column:
    """People where the compound level is more than least above the single one, else 0."""
    return F.when(compound - single > least, people).otherwise(0.0)


def resample_density(coarse: DataFrame, fine: DataFrame, ratio: int) -> DataFrame:
    """fine (row, col, area) with the people of the coarse cell (row, col, people, area) around it, by density times area."""
    c = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), (F.col("people") / F.col("area")).alias("_density"))
    f = fine.withColumns({"_r": F.floor(F.col("row") / ratio).cast("int"), "_c": F.floor(F.col("col") / ratio).cast("int")})
    return f.join(c, ["_r", "_c"], "left").select("row", "col", (F.col("_density") * F.col("area")).alias("people"))


#: Rows that a task of a neighbourhood joins, about, and pairs that a task of gauge snapping looks at.
ROWS, PAIRS = 500_000, 20_000_000


def neighbourhood(grid: DataFrame, radius: int = 1, x: str = "value", centre: bool = True) -> DataFrame:
    """(row, col, n, low, high, mean, same) over the window around each cell; the grid's edge just has fewer cells.
    Each cell is sent to the cells it neighbours, so the cost is one shuffle of (2 radius + 1)² rows per cell, in as many parts as these
    rows need; windows are summed in the part where they met."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if centre or i or j])
    sent = grid.select("row", "col", F.col(x).alias("_v"), F.explode(steps).alias("_s")).select((F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"), "_v")
    parts = max(1, -(-grid.count() * (2 * radius + 1) ** 2 // ROWS))
    own = grid.select("row", "col", F.col(x).alias("_own")).repartition(parts, "row", "col")
    both = sent.repartition(parts, "row", "col").join(own.hint("merge"), ["row", "col"])
    return both.groupBy("row", "col").agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"), F.count_if(F.col("_v") == F.col("_own")).alias("same"))


def snap_gauges(gauges: DataFrame, cells: DataFrame, max_dist: float, error: float = 0.5, percent: float = 99.0, w_area: float = 1.0, w_dist: float = 1.0) -> DataFrame:
    """gauges (id, lon, lat, area) onto cells (row, col, lon, lat, uparea), all gauges at once: one row for each pick.

    Candidates lie within max_dist metres, at any latitude and across the antimeridian, and have an area from (1 - error) to (1 +
    error) of the gauge's; a gauge without any takes those from the percentile of its cells' areas up to below the greatest.
    dist: the nearest; uparea: the least relative error of area; combi: the least weighted mean of distance by max_dist and of
    the relative error by the tolerance. dist_relerr and upa_relerr are those two. Ties go to the first row and column.

    Every pair in reach is looked at, twice: once for the least errors, which leave a task as one row a gauge, and once for the cells that
    have them. Only pairs of gauges without a fitting cell are shuffled.
    """
    c = _sent(cells.select("row", "col", F.col("lon").alias("clon"), F.col("lat").alias("clat"), "uparea"), "clon", "clat", max_dist)
    tiles = ["_tx", "_ty"]
    parts = max(1, math.ceil(_met(_tiled(gauges, "lon", "lat", max_dist), c, tiles) / PAIRS), int(gauges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fits = (F.col("uparea") >= (1 - error) * F.col("area")) & (F.col("uparea") < (1 + error) * F.col("area"))

    def pairs(some: DataFrame) -> DataFrame:
        both = _tiled(some, "lon", "lat", max_dist).repartition(parts, *tiles).join(c.repartition(parts, *tiles), tiles)
        both = both.withColumn("dist", gauge_distance(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))).where(F.col("dist") <= max_dist)
        both = both.withColumns({"upa_relerr": F.abs(F.col("uparea") - F.col("area")) / F.col("area") / error, "dist_relerr": F.col("dist") / max_dist})
        return both.withColumn("combi_relerr", (F.col("upa_relerr") * w_area + F.col("dist_relerr") * w_dist) / (w_area + w_dist))

    errors = {"_least_d": "dist_relerr", "_least_u": "upa_relerr", "_least_c": "combi_relerr"}
    shared_dir(gauges.sparkSession)
    least = pairs(gauges).groupBy("id").agg(F.max("uparea").alias("upa_local_max"), F.max(fits.cast("int")).alias("_any"), *[F.min(F.when(fits, F.col(v))).alias(k) for k, v in errors.items()]).checkpoint()
    hit = pairs(gauges.join(least.where("_any = 1"), "id")).where(fits & ((F.col("dist_relerr") == F.col("_least_d")) | (F.col("upa_relerr") == F.col("_least_u")) | (F.col("combi_relerr") == F.col("_least_c"))))
    none = pairs(gauges.join(least.where(F.coalesce("_any", F.lit(0)) == 0).select("id", "upa_local_max"), "id"))
    none = none.withColumn("_p", F.percentile("uparea", percent / 100).over(Window.partitionBy("id"))).where((F.col("uparea") >= F.col("_p")) & (F.col("uparea") < F.col("upa_local_max")))
    kept = ["row", "col", "clon", "clat", "uparea", "upa_local_max", "dist", "dist_relerr", "upa_relerr", "combi_relerr"]
    pick = lambda by: F.min(F.struct(F.col(by).alias("_by"), *kept))
    both = hit.select("id", *kept).unionByName(none.select("id", *kept))
    best = both.groupBy("id").agg(pick("dist").alias("a"), pick("upa_relerr").alias("b"), pick("combi_relerr").alias("c"))
    rows = F.array(*[F.struct(F.lit(n).alias("fit"), *[F.col(f"{s}.{k}").alias(k) for k in kept]) for n, s in (("dist", "a"), ("uparea", "b"), ("combi", "c"))])
    return best.select("id", F.inline(rows))


def in_polygons(points: DataFrame, edges: DataFrame, polygon: str = "zone", lon: str = "lon", lat: str = "lat", bands: int = 512) -> DataFrame:
    """points with the polygons they lie in, by the even-odd rule, a row for each; every point counts, equal ones too. edges
    (polygon, x1, y1, x2, y2), any number: they and the points meet in bands of latitude, as a ray from a point crosses edges of
    its own band alone. Distinct places are tested once, and the points are joined back to their place."""
    low, high = edges.agg(F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    if low is None:
        return points.limit(0).withColumn(polygon, F.lit(None).cast(edges.schema[polygon].dataType))
    step = (high - low) / bands or 1.0
    band = lambda y: F.floor((y - low) / step).cast("long")
    e = edges.where("y1 <> y2").withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    places = points.where(F.col(lat).between(low, high)).select(F.col(lon).alias("_x"), F.col(lat).alias("_y")).distinct().withColumn("_band", band(F.col("_y")))
    cross = ((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))) & (F.col("_x") < (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = places.join(e, "_band").where(cross).groupBy("_x", "_y", polygon).agg((F.count("*") % 2).alias("_odd")).where("_odd = 1").drop("_odd")
    return points.join(inside, (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y"))).drop("_x", "_y")
