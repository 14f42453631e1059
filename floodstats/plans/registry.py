"""Named queries and, where SQL can express them, the DuckDB statements they are held against."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same queries in the form in which they are held against their statements.
COMPARED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Modules of floodstats.plans that register queries.
MODULES = ("series", "skill", "circular", "climate", "ensemble", "spatial", "network", "resample", "relational", "formats", "analyses", "scheduled")


def query(oracle: str | None = None, name: str | None = None, dates: tuple[str, ...] = (), times: tuple[str, ...] = (), whole: tuple[str, ...] = ()):
    """Registers f(spark, sf_dir) under its name. dates and times: columns that both sides of the comparison give as text, since
    engines' clients differ in how they hand them over. whole: whole numbers that both give as -1 where null, for the same
    reason. The query itself keeps its dates and nulls."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        shown = {c: "yyyy-MM-dd" for c in dates} | {c: "yyyy-MM-dd HH:mm:ss.SSSSSS" for c in times}

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            new = {c: F.date_format(c, form) for c, form in shown.items()} | {c: F.coalesce(c, F.lit(-1)) for c in whole}
            return df.withColumns(new) if new else df

        QUERIES[key] = f
        COMPARED[key] = functools.wraps(f)(run)
        if oracle:
            text = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times] + [f"coalesce({c}, -1) AS {c}" for c in whole]
            ORACLES[key] = f"SELECT * REPLACE ({', '.join(text)}) FROM ({oracle})" if text else oracle
        return f

    return register


def load_all() -> None:
    for m in MODULES:
        try:
            importlib.import_module(f"floodstats.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"floodstats.plans.{m}":
                raise
