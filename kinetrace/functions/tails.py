"""Tail probabilities of the usual distributions in numpy, and as Arrow functions on columns.

Incomplete beta and gamma functions follow the continued fractions and series of the standard numerical literature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_gammaln = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def normal_cdf(z):
    return normal_sf(-np.asarray(z, dtype=float))


def normal_ppf(p):
    """Quantiles by Newton steps on a rational start."""
    p = np.asarray(p, dtype=float)
    t = np.sqrt(-2 * np.log(np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    x = np.where(p < 0.5, -x, x)
    for _ in range(4):
        x = x - (normal_cdf(x) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300)
    return x


def beta_inc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = h * c * d
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_gammaln(p + q) - _gammaln(p) - _gammaln(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(turn, 1 - out, out)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_sf2(t, df):
    """Two-sided p-value of Student's t."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def digamma(x):
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out = out - np.where(small, 1 / np.where(small, x, 1), 0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _masked(f, *cols: pd.Series) -> pd.Series:
    ok = pd.concat(cols, axis=1).notna().all(axis=1).to_numpy()
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = f(*(c.to_numpy(dtype=float)[ok] for c in cols))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(t_sf2, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(f_sf, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def normal_p2(z: pd.Series) -> pd.Series:
    return _masked(lambda v: 2 * normal_sf(np.abs(v)), z)
