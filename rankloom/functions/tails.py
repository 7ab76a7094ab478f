"""Tail probabilities for small result tables: plain Python behind Arrow, as Spark SQL has no error function."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


@lru_cache(maxsize=16)
def _u_below(n: int, m: int, most: int) -> float:
    """How many orderings of n <= m untied values have a U of at most ``most``: coefficients of the product over i of (1 - q^(m+i)) / (1 - q^i)."""
    c = np.zeros(most + 1, np.longdouble)
    c[0] = 1
    for i in range(1, n + 1):
        rows = np.concatenate([c, np.zeros(-len(c) % i, c.dtype)]).reshape(-1, i)
        c = rows.cumsum(axis=0).reshape(-1)[: most + 1]
    for i in range(1, n + 1):
        if m + i <= most:
            c[m + i :] = c[m + i :] - c[: -m - i]
    return c.sum()


def exact_u_p(u: float, n: int, m: int) -> float:
    """Two-sided exact p of U without ties, in about 2 * min * min * max steps."""
    low = n * m - int(max(u, n * m - u))
    return float(min(1.0, 2 * _u_below(min(n, m), max(n, m), low) / np.longdouble(math.comb(n + m, n))))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p: exact where the smaller group has at most 8 values and none is tied, else normal with continuity correction."""
    out = []
    for a, n, m, t in zip(u, n1, n2, ties, strict=True):
        if pd.isna(a) or n == 0 or m == 0:
            out.append(None)
            continue
        if min(n, m) <= 8 and t == 0:
            out.append(exact_u_p(a, int(n), int(m)))
            continue
        total = n + m
        var = n * m / 12 * ((total + 1) - t / (total * (total - 1)))
        z = (max(a, n * m - a) - n * m / 2 - 0.5) / math.sqrt(var) if var > 0 else 0.0
        out.append(min(1.0, 2 * normal_sf(z)) if var > 0 else 1.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t."""
    out = []
    for r, k in zip(rho, n, strict=True):
        if pd.isna(r) or k < 3:
            out.append(None)
        else:
            out.append(0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2))
    return pd.Series(out, dtype="float64")
