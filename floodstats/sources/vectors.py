"""Vector files as tables: polygons of GeoJSON as edges, points and polygons of shapefiles, also zipped."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship


def read_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties..., x1, y1, x2, y2): the edges of all rings of the polygons and multipolygons of a feature collection or of
    newline-delimited features, as operators.spatial.in_polygons takes them."""
    feature = f"struct<geometry: struct<type: string, coordinates: string>, properties: struct<{properties}>>"
    raw = spark.read.text(path, wholetext=True)
    whole = raw.select(F.from_json("value", f"struct<type: string, features: array<{feature}>>").alias("c"), "value")
    lines = whole.where("c.features is null").select(F.explode(F.split("value", "\n")).alias("v")).where("trim(v) <> ''").select(F.from_json("v", feature).alias("f"))
    f = whole.where("c.features is not null").select(F.explode("c.features").alias("f")).unionByName(lines)
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    ring = f.select("f.properties.*", F.explode(rings).alias("_r")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_r") - 2)))
    at = lambda i, k: F.get(F.get("_r", i), F.lit(k))
    i = F.col("_i")
    names = [c for c in ring.columns if c not in ("_r", "_i")]
    return ring.select(*names, at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(i + 1, 0).alias("x2"), at(i + 1, 1).alias("y2"))


def decode_shapes(raw: bytes) -> list[list[list[tuple[float, float]]]]:
    """Parts of points of each record of a .shp file: points, multipoints, lines and polygons, also with z or m, which are dropped."""
    if struct.unpack_from(">i", raw)[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 12 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        kind, body = struct.unpack_from("<i", raw, at + 8)[0] % 10, at + 12
        if kind == 1:
            out.append([[struct.unpack_from("<dd", raw, body)]])
        elif kind == 8:
            n = struct.unpack_from("<i", raw, body + 32)[0]
            out.append([[struct.unpack_from("<dd", raw, body + 36 + 16 * i) for i in range(n)]])
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<ii", raw, body + 32)
            first = [*struct.unpack_from(f"<{parts}i", raw, body + 40), n]
            pts = [struct.unpack_from("<dd", raw, body + 40 + 4 * parts + 16 * i) for i in range(n)]
            out.append([pts[a:b] for a, b in zip(first, first[1:])])
        else:
            out.append([])
        at += 8 + size
    return out


def decode_dbf(raw: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Records of a .dbf file, as text without padding."""
    n, head, width = struct.unpack_from("<IHH", raw, 4)
    fields, at, place = [], 32, 1
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("ascii")
        fields.append((name, place, raw[at + 16]))
        place += raw[at + 16]
        at += 32
    rows = (raw[head + i * width : head + (i + 1) * width] for i in range(n))
    return [{name: r[a : a + k].decode(encoding, "replace").strip(" \0") for name, a, k in fields} for r in rows]


def read_shapefile(spark: SparkSession, path: str, properties: list[str], edges: bool = False) -> DataFrame:
    """Zip archives of a .shp and its .dbf, a task for each: (file, record, part, properties as text..., lon, lat) of every point, or
    with edges (..., x1, y1, x2, y2) from each point of a part to the next."""
    own = ["x1", "y1", "x2", "y2"] if edges else ["lon", "lat"]
    names = ["file", "record", "part", *properties, *own]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                z = zipfile.ZipFile(io.BytesIO(r.content))
                by = {x.rsplit(".", 1)[-1].lower(): z.read(x) for x in z.namelist()}
                rows = []
                for k, (parts, record) in enumerate(zip(decode_shapes(by["shp"]), decode_dbf(by["dbf"]))):
                    for j, pts in enumerate(parts):
                        values = zip(pts, pts[1:]) if edges else ((p,) for p in pts)
                        rows += [(r.path, k, j, *(record.get(p) for p in properties), *(x for p in v for x in p)) for v in values]
                yield pd.DataFrame(rows, columns=names)

    ship(spark)
    schema = "file string, record long, part int, " + "".join(f"`{p}` string, " for p in properties) + ", ".join(f"{c} double" for c in own)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
