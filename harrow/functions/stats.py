"""Interval and test statistics as Column expressions; iterative ones as Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .beta import beta_fraction, binomial_tail, incomplete_beta  # noqa: F401

Z95, Z90 = 1.96, 1.645


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95, empty: float | None = None) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval; for n = 0 null, or `empty` if given."""
    n_ = F.when(n > 0, n.cast("double"))
    p = k / n_
    denominator = 1 + z * z / n_
    middle = (p + z * z / (2 * n_)) / denominator
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / denominator
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    # greatest and least skip nulls, so the empty case is said here
    low, high = F.when(n > 0, low), F.when(n > 0, high)
    return (low, high) if empty is None else (F.coalesce(low, F.lit(empty)), F.coalesce(high, F.lit(empty)))


def beta_mean(alpha: Column, beta: Column) -> tuple[Column, Column, Column, Column]:
    """Mean, lower, upper (90 %, normal approximation, clamped) and deviation of a beta."""
    s = alpha + beta
    mean = alpha / s
    sd = F.sqrt(alpha * beta / (s * s * (s + 1)))
    return mean, F.greatest(F.lit(0.0), mean - Z90 * sd), F.least(F.lit(1.0), mean + Z90 * sd), sd


def erf(x: Column) -> Column:
    """Polynomial of five terms, absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def prob_above(alpha: Column, beta: Column, baseline: Column) -> Column:
    """P(rate > baseline) under the beta's normal approximation; a step where it has no width."""
    mean, _, _, sd = beta_mean(alpha, beta)
    step = F.when(mean > baseline, 1.0).when(mean < baseline, 0.0).otherwise(0.5)
    return F.when(sd > 0, 1 - normal_cdf((baseline - mean) / sd)).otherwise(step)


def cloglog_interval(f: Column, variance: Column, z: float = Z95) -> tuple[Column, Column]:
    """Complementary log-log interval of a cumulative incidence; plain normal bounds at 0 and 1."""
    sd = F.sqrt(F.greatest(variance, F.lit(0.0)))
    inside = (f > 0) & (f < 1) & (variance > 0)
    safe = F.when(inside, f)
    width = z * sd / (F.abs((1 - safe) * F.log(1 - safe)))
    base = F.log(-F.log(1 - safe))
    low = F.when(inside, 1 - F.exp(-F.exp(base - width))).otherwise(F.greatest(F.lit(0.0), f - z * sd))
    high = F.when(inside, 1 - F.exp(-F.exp(base + width))).otherwise(F.least(F.lit(1.0), f + z * sd))
    return low, high


def pearson(x: Column, y: Column) -> Column:
    """Correlation, 0 where it is undefined (an aggregate)."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def median(x: Column) -> Column:
    """Exact median, 0 for none (an aggregate; for small groups - it holds the group's values)."""
    return F.coalesce(F.percentile(x, F.lit(0.5)), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def inverse_normal(p: pd.Series) -> pd.Series:
    """The standard normal quantile."""
    from statistics import NormalDist

    n = NormalDist()
    return pd.Series([n.inv_cdf(x) if x is not None and 0 < x < 1 else None for x in p], dtype="float64")
