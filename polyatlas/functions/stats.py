"""Distribution tails that Spark has no function for, as Arrow-batched numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ERFC = np.frompyfunc(math.erfc, 1, 1)
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def normal_sf_array(z: np.ndarray) -> np.ndarray:
    return 0.5 * _ERFC(np.asarray(z, dtype=float) / math.sqrt(2)).astype(float)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, steps):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
            f *= c * d
    value = np.where(x <= 0, 0.0, front * f)
    return np.where(swap, 1 - value, value)


def t_two_sided_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.clip(incomplete_beta(df / 2, 0.5, df / (df + t * t)), 0, 1)


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    return pd.Series(normal_sf_array(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_array(t.to_numpy(), df.to_numpy()))
