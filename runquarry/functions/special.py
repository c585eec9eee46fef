"""Tail probabilities used by the significance tests (numpy in a pandas UDF)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the finite sums for even and odd ``df``."""
    if x is None or math.isnan(x) or df < 1:
        return math.nan
    half = x / 2.0
    if half <= 0:
        return 1.0
    if df % 2 == 0:
        terms = [i * math.log(half) - half - math.lgamma(i + 1) for i in range(df // 2)]
        return min(1.0, math.fsum(math.exp(t) for t in terms))
    terms = [(i - 0.5) * math.log(half) - half - math.lgamma(i + 0.5) for i in range(1, (df - 1) // 2 + 1)]
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(math.exp(t) for t in terms))


def studentized_range_tail(q: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals > q) for an array of q, infinite degrees of freedom.

    The normal distribution is tabulated once; between the points it is read off by its first derivatives.
    """
    z = np.linspace(-9.0, 9.0, 4001)
    width = z[1] - z[0]
    phi = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    table = np.array([0.5 * math.erfc(-t / math.sqrt(2.0)) for t in z])

    def cdf(x: np.ndarray) -> np.ndarray:
        at = np.clip(np.rint((x + 9.0) / width).astype(np.int64), 0, len(z) - 1)
        d = np.clip(x - z[at], -width, width)
        return table[at] + phi[at] * d * (1.0 - z[at] * d / 2.0 + (z[at] ** 2 - 1.0) * d * d / 6.0)

    out = np.empty(len(q))
    for i, value in enumerate(q):
        f = phi * np.power(np.clip(table - cdf(z - value), 0.0, 1.0), k - 1)
        out[i] = 1.0 - k * width * (f.sum() - 0.5 * (f[0] + f[-1]))
    return np.clip(out, 0.0, 1.0)


def chi2_sf(x: Column, df: Column) -> Column:
    """Column form of :func:`chi2_tail`."""

    def tails(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, df)], dtype="float64")

    return F.pandas_udf(tails, T.DoubleType())(x, df)


def studentized_range_sf(q: Column, k: Column) -> Column:
    """Column form of :func:`studentized_range_tail`."""

    def tails(q: pd.Series, k: pd.Series) -> pd.Series:
        out = np.full(len(q), np.nan)
        for size in k.unique():
            rows = (k == size).to_numpy()
            out[rows] = studentized_range_tail(q.to_numpy(dtype="float64")[rows], int(size))
        return pd.Series(out)

    return F.pandas_udf(tails, T.DoubleType())(q, k)
