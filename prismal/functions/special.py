"""Distribution functions for small result tables, as vectorised column functions.

Spark has no incomplete beta or gamma function; these take one row for each test, not data rows, and run as
Arrow UDFs over continued fractions in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEPS, _TINY = 300, 1e-300


def betainc(a, b, x):
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a)[ok], np.where(flip, a, b)[ok], np.where(flip, 1 - x, x)[ok]
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p if len(p) else p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(abs(d) < _TINY, _TINY, d)
        h = d.copy()
        for m in range(1, _STEPS):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(abs(d) < _TINY, _TINY, d)
                c = 1 + top / c
                c = np.where(abs(c) < _TINY, _TINY, c)
                h = h * d * c
    value = np.where(y == 0, 0.0, front * h)
    out[ok] = np.where(flip[ok], 1 - value, value)
    return out


def gammaq(a, x):
    """Regularised upper incomplete gamma function."""
    def one(a, x):
        if not (a > 0 and x >= 0):
            return math.nan
        front = math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0
        if x < a + 1:
            term = total = 1 / a
            for k in range(1, 2000):
                term *= x / (a + k)
                total += term
                if term < total * 1e-16:
                    break
            return 1 - front * total
        b, c, d = x + 1 - a, 1 / _TINY, 1 / (x + 1 - a)
        h = d
        for k in range(1, 2000):
            top = -k * (k - a)
            b += 2
            d = 1 / (top * d + b)
            c = b + top / c
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return front * h

    return np.vectorize(one, otypes=[float])(np.asarray(a, dtype=float), np.asarray(x, dtype=float))


def t_tail(t, df):
    """P(T > t)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    half = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return np.where(t > 0, half, 1 - half)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2 * t_tail(t.abs(), df))


@F.pandas_udf(DoubleType())
def t_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t, df))


@F.pandas_udf(DoubleType())
def f_greater(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


@F.pandas_udf(DoubleType())
def chi2_greater(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gammaq(df / 2, x / 2))


@F.pandas_udf(DoubleType())
def normal_greater(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """The t below which a share p of the distribution lies, by bisection of its tail."""
    p, df = p.to_numpy(dtype=float), df.to_numpy(dtype=float)
    lo, hi = np.full(len(p), -1e6), np.full(len(p), 1e6)
    for _ in range(100):
        mid = (lo + hi) / 2
        above = t_tail(mid, df) > 1 - p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return pd.Series((lo + hi) / 2)
