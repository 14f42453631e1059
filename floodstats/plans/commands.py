"""What the command line runs: time series at points or over polygons from gridded files, item by item of a settings file, and binary
grids as GeoTIFF tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.shared import shared_dir
from ..operators import ordered, relational, spatial
from ..sources import arrays, grids, rasters, sinks, vectors, zarr


#: Distinct values beyond which a coordinate is taken for no axis of a grid; and ways of counting times in one set of files.
MOST_VALUES, MOST_UNITS = 100_000_000, 1000


def gridded(spark: SparkSession, files: str, variable: str, coords: list[str], time: str | None = None) -> DataFrame:
    """(coords..., value) of a Zarr group (a path that ends in .zarr), GeoTIFFs or netCDF files. time: the coordinate that becomes a
    timestamp, by the units and calendar that each netCDF file has for it, or the group for all."""
    if files.rstrip("/").endswith(".zarr"):
        z = rasters.read_zarr(spark, files.rstrip("/"), variable, {c: c for c in coords})
        out = z.select(*[F.col(f"{c}_value").alias(c) for c in coords], "value")
        if not time:
            return out
        told = zarr.Array(files.rstrip("/"), time).attributes
        return out.withColumn(time, calendar.cf_time(F.col(time), told["units"], told.get("calendar", "standard")))
    if files.endswith((".tif", ".tiff")):
        return rasters.read_geotiff(spark, files).select(*[F.col(c) if c in ("lon", "lat") else F.col("band").cast("double").alias(c) for c in coords], "value")
    own = rasters.read_netcdf(spark, files, variable, coords, time)
    if not time:
        return own.select(*coords, "value")
    ways = rasters.netcdf_units(spark, files, variable, time).select("units", "calendar").distinct().limit(MOST_UNITS + 1).collect()
    if len(ways) > MOST_UNITS or any(w.units is None for w in ways):
        raise ValueError(f"{time} has no units in some file, or more than {MOST_UNITS} in all")
    same = lambda w: F.col("units").eqNullSafe(F.lit(w.units)) & F.col("calendar").eqNullSafe(F.lit(w.calendar))
    when = [F.when(same(w), calendar.cf_time(F.col(time), w.units, w.calendar or "standard")) for w in ways]
    return own.withColumn(time, F.coalesce(*when) if when else F.lit(None).cast("timestamp")).select(*coords, "value")


def _axes(cells: DataFrame, names: list[str]) -> DataFrame:
    """(name, v): the values of each coordinate, once, from one reading of the cells."""
    shared_dir(cells.sparkSession)
    every = cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("_a")).select("_a.*")
    axes = every.where(F.col("v").isNotNull() & ~F.isnan("v")).distinct().checkpoint()
    n = {r["name"]: r["n"] for r in axes.groupBy("name").agg(F.count("*").alias("n")).collect()}
    for c in names:
        if c not in n:
            raise ValueError("the grid has no cells")
        if n[c] > MOST_VALUES:
            raise ValueError(f"{c} has more than {MOST_VALUES} values; it is no axis of a grid")
    return axes


def _nearest(points: DataFrame, name: str, axis: DataFrame) -> DataFrame:
    """(at, v): for each coordinate of the points the axis' value nearest to it, the greater one of two; none for those beyond half a
    step outside of it. Values and coordinates lie in one order, in ranges, so neither an axis nor the points have to fit a task."""
    low, high = ([r.v for r in axis.orderBy(way("v")).limit(2).collect()] for way in (F.asc, F.desc))
    first, last = (low[1] - low[0], high[0] - high[1]) if len(low) > 1 else (1.0, 1.0)
    at = points.select(F.col(name).alias("at")).where(F.col("at").between(low[0] - first / 2, high[0] + last / 2)).distinct()
    both = axis.select(F.col("v").alias("at"), F.lit(0).alias("_g"), "v").unionByName(at.select("at", F.lit(1).alias("_g"), F.lit(None).cast("double").alias("v")))
    sided = ordered.carried(both, [], ["at", "_g"], {"_a": "v"}, {"_b": "v"}).where("_g = 1")
    greater = F.col("_a").isNull() | (F.abs(F.col("_b") - F.col("at")) <= F.abs(F.col("_a") - F.col("at")))
    return sided.select("at", F.when(greater, F.col("_b")).otherwise(F.col("_a")).alias("v"))


def extract_points(cells: DataFrame, points: DataFrame, x: str = "lon", y: str = "lat", index: str = "index") -> DataFrame:
    """(index, other coords..., value): the series of the cell nearest in x and in y, of the values that the grid's axes really have, at each point (index, x, y); points more than
    half a step off the grid have none. Axes need not be regular."""
    rest = [c for c in cells.columns if c not in (x, y, "value")]
    axes = _axes(cells, [x, y])
    near = points.select(index, *[F.col(c).cast("double").alias(c) for c in (x, y)])
    for c in (x, y):
        near = near.join(_nearest(near, c, axes.where(F.col("name") == c).select("v")).withColumnRenamed("at", c), c).drop(c).withColumnRenamed("v", c)
    return cells.where(F.col("value").isNotNull()).join(near, [x, y]).select(index, *rest, "value")


def extract_zones(cells: DataFrame, edges: DataFrame, reducer: str = "mean", x: str = "lon", y: str = "lat", index: str = "index") -> DataFrame:
    """(index, other coords..., value): mean or sum over the cells whose centres lie in each polygon."""
    rest = [c for c in cells.columns if c not in (x, y, "value")]
    inside = spatial.in_polygons(cells.select(x, y).distinct(), edges, index, x, y)
    return cells.join(inside, [x, y]).groupBy(index, *rest).agg({"mean": F.avg, "sum": F.sum}[reducer]("value").alias("value"))


def extract(spark: SparkSession, files: str, where: str, out: str, variable: str | list[str], coords: list[str], reducer: str = "mean", index: str = "index", x: str = "lon", y: str = "lat", time: str | None = None, keep_attributes: bool = False) -> None:
    """where: a CSV file of points, or polygons as GeoJSON (.geojson, .json) with an integer property `index`. Several variables become
    columns of their names, one is `value`. time: a coordinate that is decoded to timestamps; each file of the output is sorted by
    point and coords. keep_attributes: the other columns of the points are kept."""
    names = [variable] if isinstance(variable, str) else list(variable)
    areas = where.endswith((".geojson", ".json"))
    if areas:
        edges = vectors.read_polygons(spark, where, f"`{index}`: long")
    else:
        told = spark.read.csv(where, header=True).withColumn(index, F.col(index).cast("long"))
        points = told.select(index, *[F.col(c).cast("double").alias(c) for c in (x, y)])
    rest, got = [c for c in coords if c not in (x, y)], []
    for name in names:
        cells = gridded(spark, files, name, coords, time)
        one = extract_zones(cells, edges, reducer, x, y, index) if areas else extract_points(cells, points, x, y, index)
        got.append(one.withColumnRenamed("value", name) if len(names) > 1 else one)
    series = relational.merge(got, [index, *rest])
    if keep_attributes and not areas:
        more = [c for c in told.columns if c != index]
        series = series.join(told.select(index, *[F.col(f"`{c}`").alias(f"{c}_point" if c in series.columns else c) for c in more]), index)
    sinks.write_table(series.repartition(index).sortWithinPartitions(index, *rest), out)


def postprocess(spark: SparkSession, settings: dict, folder: str, out: str, items: list[str] | None = None, force: bool = False) -> list[str]:
    """Every item of settings {"items": [{"name", "files", "where", "variable", "coords", "reducer"?}]}, its files under folder, to
    out/<name>; items that are there already are left unless forced. Gives the names of those done."""
    done = []
    for item in settings["items"]:
        own = dict(item)
        name, files, target = own.pop("name"), own.pop("files"), f"{out}/{item['name']}"
        if (items and name not in items) or (not force and sinks.exists(spark, f"{target}/_SUCCESS")):
            continue
        extract(spark, f"{folder}/{files}", own.pop("where"), target, **own)
        done.append(name)
    return done


def grid_to_geotiff(spark: SparkSession, control: str, out: str, side: int = 512) -> int:
    """A GrADS descriptor's binary file as GeoTIFF tiles, a folder out/<band> for each band; gives the number of tiles."""
    g = grids.read_control(control)
    cells, n = grids.read_grid(spark, g.file, g), 0
    for band in range(g.bands):
        n += arrays.write_geotiff_tiles(cells.where(F.col("band") == band), f"{out}/{band}", g.west, g.north, g.dx, -g.dy, side, g.missing if g.missing is not None else -9999.0)
    return n


