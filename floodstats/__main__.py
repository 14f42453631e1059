"""python -m floodstats list
python -m floodstats run NAME SF_DIR OUT
python -m floodstats extract FILES WHERE OUT --variable V[,V] --coords time,lat,lon [--time T] [--keep-attributes] [--reducer mean|sum] [--index I] [--x lon] [--y lat]
python -m floodstats postprocess SETTINGS.json FOLDER OUT [--item NAME ...] [--force]
python -m floodstats bin-to-tif CONTROL OUT [--side 512]"""

from __future__ import annotations

import argparse
import sys

from .plans.registry import QUERIES, load_all


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="floodstats", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    for a in ("name", "sf_dir", "out"):
        run.add_argument(a)
    extract = sub.add_parser("extract")
    for a in ("files", "where", "out"):
        extract.add_argument(a)
    extract.add_argument("--variable", required=True, type=lambda s: s.split(","))
    extract.add_argument("--time")
    extract.add_argument("--keep-attributes", action="store_true")
    extract.add_argument("--coords", required=True, type=lambda s: s.split(","))
    extract.add_argument("--reducer", choices=("mean", "sum"), default="mean")
    for a, default in (("index", "index"), ("x", "lon"), ("y", "lat")):
        extract.add_argument(f"--{a}", default=default)
    post = sub.add_parser("postprocess")
    for a in ("settings", "folder", "out"):
        post.add_argument(a)
    post.add_argument("--item", action="append")
    post.add_argument("--force", action="store_true")
    tif = sub.add_parser("bin-to-tif")
    for a in ("control", "out"):
        tif.add_argument(a)
    tif.add_argument("--side", type=int, default=512)
    return p


def main(args: list[str]) -> int:
    load_all()
    try:
        own = vars(parser().parse_args(args))
    except SystemExit as e:
        return int(e.code or 0)
    command = own.pop("command")
    if command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if command == "run" and own["name"] not in QUERIES:
        print(f"no query {own['name']}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .plans import commands
    from .sources.config import read_json

    spark = SparkSession.builder.getOrCreate()
    if command == "run":
        QUERIES[own["name"]](spark, own["sf_dir"]).write.mode("overwrite").parquet(own["out"])
    elif command == "extract":
        commands.extract(spark, **own)
    elif command == "postprocess":
        print("\n".join(commands.postprocess(spark, read_json(own["settings"]), own["folder"], own["out"], own["item"], own["force"])))
    else:
        print(commands.grid_to_geotiff(spark, **own))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
