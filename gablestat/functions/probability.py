"""Tail probabilities for the handful of rows a test produces.

Moments are aggregated by Spark; these helpers only turn finished statistics into
p-values, through Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_sf(b: float, u: float) -> float:
    """Regularised upper incomplete gamma function: a series below ``b + 1``, a continued fraction above."""
    if u <= 0.0:
        return 1.0
    front = math.exp(b * math.log(u) - u - math.lgamma(b))
    if u < b + 1.0:
        term = total = 1.0 / b
        n = b
        while term > total * 1e-17:
            n += 1.0
            term *= u / n
            total += term
        return 1.0 - front * total
    step, above = u + 1.0 - b, 1e300
    below = fraction = 1.0 / step
    for i in range(1, _STEPS):
        step += 2.0
        below = 1.0 / (step - i * (i - b) * below)
        above = step - i * (i - b) / above
        fraction *= above * below
        if abs(above * below - 1.0) < 1e-15:
            return front * fraction
    raise ArithmeticError(f"the incomplete gamma function did not settle for {b}, {u}")


_STEPS = 200_000


def beta_cdf(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is 1 - x where the caller knows it to more digits.

    A continued fraction (modified Lentz). Its factors cancel where one parameter is huge, so from 1e8 on the limit
    takes over: ``-(a + (b - 1) / 2) log(x)`` is then gamma distributed but for a part of order ``b ** 3 / (24 a ** 2)``.
    """
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if a >= 1e8 and b**3 <= 2.4e-10 * a * a:
        return _gamma_sf(b, -(a + (b - 1.0) / 2.0) * (math.log1p(-rest) if rest < 0.5 else math.log(x)))
    if b >= 1e8 and a**3 <= 2.4e-10 * b * b:
        return 1.0 - beta_cdf(rest, b, a, x)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(rest, b, a, x)
    logs = [math.log(v) if v < 0.5 else math.log1p(-w) for v, w in ((x, rest), (rest, x))]
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * logs[0] + b * logs[1]) / a
    tiny = 1e-300
    fraction, c, d = 1.0, 1.0, 0.0
    for i in range(_STEPS):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or tiny)
        c = (1.0 + term / c) or tiny
        fraction *= c * d
        if i > 1 and abs(c * d - 1.0) < 1e-15:
            return front * (fraction - 1.0)
    raise ArithmeticError(f"the incomplete beta function did not settle for {x}, {a}, {b}")


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    square = t * t
    half = 0.5 * beta_cdf(df / (df + square), df / 2.0, 0.5, square / (df + square))
    return half if t >= 0 else 1.0 - half


def f_sf(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0, df1 * f / (df2 + df1 * f))


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    while t_sf(hi, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_sf(mid, df) > 1.0 - p else (lo, mid)
    return (lo + hi) / 2.0


_erf = np.vectorize(math.erf, otypes=[float])


def _phi_cdf(z):
    return 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))


@lru_cache(maxsize=8)
def _nodes(n: int):
    return np.polynomial.legendre.leggauss(n)


@lru_cache(maxsize=64)
def _scale_rule(df: float):
    """Nodes and weights for the distribution of s = sqrt(chi2(df) / df)."""
    x, w = _nodes(96)
    spread = 9.0 / math.sqrt(2.0 * df)
    lo, hi = max(0.0, 1.0 - spread), 1.0 + spread + (4.0 / df)
    s = lo + (x + 1.0) * (hi - lo) / 2.0
    log_density = (
        math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(np.maximum(s, 1e-300)) - df * s * s / 2.0
    )
    return s, w * (hi - lo) / 2.0 * np.exp(log_density)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) for the range of k means with df error degrees of freedom, by double quadrature."""
    if q <= 0:
        return 1.0
    x, w = _nodes(160)
    z = 8.5 * x
    density = 8.5 * w * np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    s, weight = _scale_rule(float(df))
    upper = _phi_cdf(z)
    gap = np.clip(upper[None, :] - _phi_cdf(z[None, :] - q * s[:, None]), 0.0, 1.0)
    inner = k * (density[None, :] * gap ** (k - 1)).sum(axis=1)
    return float(min(1.0, max(0.0, 1.0 - (weight * inner).sum() / weight.sum())))


@lru_cache(maxsize=64)
def studentized_range_quantile(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 4.0
    while studentized_range_sf(hi, k, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(60):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if studentized_range_sf(mid, k, df) > 1.0 - p else (lo, mid)
    return (lo + hi) / 2.0


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([None if any(pd.isna(x) for x in row) else fn(*row) for row in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T > t) per row."""
    return _rowwise(t_sf, t, df)


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F > f) per row."""
    return _rowwise(f_sf, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def range_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Tukey-adjusted p-value per row."""
    return _rowwise(lambda a, b, c: studentized_range_sf(a, int(b), c), q, k, df)


@F.pandas_udf(T.DoubleType())
def range_critical(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(lambda a, b, c: studentized_range_quantile(float(a), int(b), float(c)), p, k, df)
