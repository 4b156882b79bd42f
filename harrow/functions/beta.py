"""The regularised incomplete beta function, its continued fraction, and exact binomial tails on it.

All rows of an Arrow batch are computed at once, in memory of the batch's size whatever the
arguments. Powers and gamma functions go into one factor by their deviance and the error of Stirling's
formula, so that large arguments lose no digits; the fraction runs until every row has settled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """log gamma(x + 1) less Stirling's formula, for x > 0."""
    y = np.maximum(x, 16.0)
    s = 1 / (y * y)
    out = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y
    for i in np.flatnonzero(x < 16):
        v = float(x[i])
        out[i] = math.lgamma(v + 1) - (v + 0.5) * math.log(v) + v - _HALF_LOG_2PI
    return out


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x; by its series in (x - mean) / (x + mean) where that is small."""
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    out = np.where(near, 0.0, x * np.log(np.where(near, 1.0, x / mean)) + mean - x)
    u = np.where(near, v, 0.0)
    # 2 x (v^3/3 + v^5/5 + ...) + (x - mean) v
    power, series = u.copy(), np.zeros_like(u)
    for j in range(1, 12):
        power = power * u * u
        series += power / (2 * j + 1)
    return out + np.where(near, (x - mean) * u + 2 * x * series, 0.0)


def _factor(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x^a y^b / B(a, b), y = 1 - x."""
    n = a + b
    log = _stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * y)
    return np.exp(log) * np.sqrt(a * b / n / (2 * math.pi))


def fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's recurrence.

    It settles after some sqrt(max(a, b)) steps where x is below (a + 1) / (a + b + 2); a row that has
    not settled by 400 and 30 of those raises."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.empty(len(a))
    row = np.arange(len(a))
    c = np.ones(len(a))
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    step = 0
    most = 400 + 30 * math.sqrt(max(1.0, float(np.max(np.maximum(a, b), initial=0))))
    while len(row):
        step += 1
        if step > most:
            raise ArithmeticError(f"the fraction has not settled after {step} steps")
        even = a + 2 * step
        for term in (step * (b - step) * x / ((even - 1) * even), -(a + step) * (a + b + step) * x / (even * (even + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * (c * d)
        live = np.abs(c * d - 1) > 1e-15
        if not live.all():
            out[row[~live]] = h[~live]
            row, a, b, x, c, d, h = (v[live] for v in (row, a, b, x, c, d, h))
    return out


def incomplete(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for a, b > 0; 0 for x <= 0 and 1 for x >= 1; not a number otherwise."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, 0.0, 1.0)
    valid = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b) & ~np.isnan(x)
    out[~valid] = np.nan
    inside = np.flatnonzero(valid & (x > 0) & (x < 1))
    a, b, x = a[inside], b[inside], x[inside]
    far = x >= (a + 1) / (a + b + 2)  # there its mirror image settles faster
    p, q, u = np.where(far, b, a), np.where(far, a, b), np.where(far, 1 - x, x)
    part = _factor(p, q, u, 1 - u) * fraction(p, q, u) / p
    out[inside] = np.clip(np.where(far, 1 - part, part), 0.0, 1.0)
    return out


def tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X binomial(n, p): 1 for k <= 0 or n <= 0, 0 for k > n; not a number stays one."""
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    usual = (k > 0) & (k <= n) & (n > 0)
    out = np.where(k <= 0, 1.0, np.where(n <= 0, 1.0, 0.0))
    out[usual] = incomplete(k[usual], n[usual] - k[usual] + 1, p[usual])
    out[np.isnan(k) | np.isnan(n) | np.isnan(p)] = np.nan
    return out


def _column(f):
    """A column function of three numbers; null or undefined arguments give null."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        out = f(*(v.astype("float64").to_numpy() for v in (a, b, x)))
        return pd.Series(out).where(~np.isnan(out), None)

    return run


@_column
def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return incomplete(a, b, x)


@_column
def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The fraction alone, for 0 <= x < (a + 1) / (a + b + 2); null beyond it."""
    out = np.full(len(a), np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x < (a + 1) / (a + b + 2))
    out[ok] = fraction(a[ok], b[ok], x[ok])
    return out


@_column
def binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return tail(k, n, p)
