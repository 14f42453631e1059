"""Functions of the user over whole series, where no expression exists: the last resort, by Arrow and pandas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.ship import ship


def apply_series(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, t: str = "t") -> DataFrame:
    """f of each series, ordered by time, as a pandas frame. A series must fit a worker's memory."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(lambda own: f(own.sort_values(t)), schema)


def reduce_series(df: DataFrame, keys: list[str], f: Callable[..., float | list[float]], columns: list[str], names: list[str], t: str = "t") -> DataFrame:
    """(keys, names...): f(arrays of the columns, in order of time) gives one number for each name. Nulls are NaN there."""
    kinds = dict(df.dtypes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        got = f(*[own[c].to_numpy(float) for c in columns])
        row = {k: own[k].iloc[0] for k in keys} | dict(zip(names, np.atleast_1d(got).tolist()))
        return pd.DataFrame([row])

    return apply_series(df, keys, run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` double" for n in names)]), t)


def transform_series(df: DataFrame, keys: list[str], f: Callable[[np.ndarray], np.ndarray], x: str = "x", out: str = "y", t: str = "t") -> DataFrame:
    """df with out = f(values in order of time), of the same length."""
    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return apply_series(df, keys, lambda own: own.assign(**{out: f(own[x].to_numpy(float))}), f"{fields}, `{out}` double", t)
