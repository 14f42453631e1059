"""Writers: Parquet with provenance, fixed-format CSV, GeoJSON, files by year, keyed updates, flat binary grids."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def described(df: DataFrame, attributes: dict[str, dict]) -> DataFrame:
    """Columns with metadata (unit, description, ...); it stays in Parquet's schema."""
    for c, meta in attributes.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, **meta})
    return df


def provenance(df: DataFrame, institution: str, history: str) -> DataFrame:
    first = df.columns[0]
    return described(df, {first: {"institution": institution, "date_created": datetime.date.today().isoformat(), "history": history}})


def write_table(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "zstd", if_exists: str = "overwrite", files: int | None = None) -> None:
    """Parquet in folders by the columns of `by`, each written by the tasks of its own values. if_exists: overwrite, ignore, error."""
    out = df.repartition(*([files] if files else []), *by) if by else df.coalesce(files) if files else df
    w = out.write.mode(if_exists).option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_by_year(df: DataFrame, path: str, t: str = "t", **how) -> None:
    write_table(df.withColumn("year", F.year(t)), path, ["year"], **how)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Doubles with a fixed number of decimals, as '%.6f' has them."""
    fixed = {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(fixed).write.mode("overwrite").csv(path, header=True)


def features(df: DataFrame, lon: str = "lon", lat: str = "lat", line: str | None = None) -> DataFrame:
    """One GeoJSON feature a row; line: an array of structs (lon, lat) instead of a point."""
    kind, where = ("LineString", F.transform(line, lambda p: F.array(p["lon"], p["lat"]))) if line else ("Point", F.array(lon, lat))
    rest = [c for c in df.columns if c not in (lon, lat, line)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), where.alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, **how) -> None:
    """Newline-delimited features, which readers of GeoJSON sequences take."""
    features(df, **how).write.mode("overwrite").text(path)


def update_cells(spark: SparkSession, path: str, new: DataFrame, out: str) -> None:
    """The cells of a table with those of new put over them where they have data, written beside it."""
    from ..operators.spatial import mosaic_update

    mosaic_update(spark.read.parquet(path), new.where("value is not null")).write.mode("overwrite").parquet(out)


def to_binary(cells: DataFrame, rows: int, cols: int, missing: float = -9999.0, dtype: str = "<f4", max_cells: int = 20_000_000) -> bytes:
    """A grid's bytes, on the driver: for the input files of an external model. Its size is checked first."""
    if rows * cols > max_cells:
        raise ValueError(f"{rows} x {cols} cells are more than {max_cells}; write them by blocks")
    out = np.full((rows, cols), missing, dtype)
    got = cells.select("row", "col", "value").where("value is not null").toPandas()
    out[got["row"], got["col"]] = got["value"]
    return out.tobytes()
