"""Distribution functions that Spark lacks, as Arrow functions over whole batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ship import ship


def beta_regularized(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by its continued fraction (Lentz), for all elements at once."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 300):
            for t in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + t * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + t / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    p = beta_regularized(df / 2, 0.5, df / (df + t.astype(float) ** 2))
    return pd.Series(np.where(t.isna() | (df <= 0), np.nan, p), dtype=object).where(~(t.isna() | (df <= 0)), None)


def _cdf(x: pd.Series) -> pd.Series:
    return x.map(NormalDist().cdf, na_action="ignore").astype(float)


def _quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else math.copysign(math.inf, v - 0.5), na_action="ignore").astype(float)


# Made when called: a worker that imports this module has no session to make them with.
def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|) of Student's t; null where t is or there are no degrees of freedom."""
    ship()
    return F.pandas_udf(_t, "double")(t, df)


def normal_cdf(x: Column | str) -> Column:
    ship()
    return F.pandas_udf(_cdf, "double")(x)


def normal_quantile(p: Column | str) -> Column:
    ship()
    return F.pandas_udf(_quantile, "double")(p)
