"""Special functions in numpy, and as Arrow UDFs where SQL has none: incomplete beta, beta and t quantiles, normal, binomial tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    return h


def beta_cdf(x, a, b) -> np.ndarray:
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    flip = inside > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
    part = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1 - part, part)))


def beta_ppf(p, a, b) -> np.ndarray:
    """Quantile of the beta distribution, by bisection."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (p, a, b)))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def t_ppf(p: float, df) -> np.ndarray:
    """Quantile of Student's t for p >= 1/2."""
    df = np.asarray(df, dtype=float)
    x = beta_ppf(2 * (1 - p), df / 2, np.full(df.shape, 0.5))
    return np.sqrt(df * (1 - x) / x)


def normal_cdf(x) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, dtype=float) / math.sqrt(2)))


def binomial_two_sided(k, n) -> np.ndarray:
    """Exact two-sided p of k out of n at one half."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    least = np.minimum(k, n - k)
    tail = np.where(least + 1 > n, 1.0, 1 - beta_cdf(0.5, least + 1, np.maximum(n - least, 1e-9)))
    return np.minimum(1.0, 2 * tail)


def beta_interval(a: Column, b: Column, level: float = 0.95) -> Column:
    """struct(low, high) of the equal-tailed interval of Beta(a, b)."""

    @F.pandas_udf("low double, high double")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = a.to_numpy(dtype=float), b.to_numpy(dtype=float)
        return pd.DataFrame({"low": beta_ppf((1 - level) / 2, x, y), "high": beta_ppf((1 + level) / 2, x, y)})

    return of(a, b)


def two_sided_p(mean: Column, std: Column) -> Column:
    @F.pandas_udf("double")
    def of(m: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(2 * (1 - normal_cdf(np.abs(m.to_numpy(dtype=float)) / np.maximum(s.to_numpy(dtype=float), 1e-12))))

    return of(mean, std)


def mcnemar_p(b: Column, c: Column) -> Column:
    @F.pandas_udf("double")
    def of(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(binomial_two_sided(b.to_numpy(dtype=float), (b + c).to_numpy(dtype=float)))

    return of(b, c)


def welch_interval(mean1: Column, var1: Column, n1: Column, mean2: Column, var2: Column, n2: Column, alpha: float = 0.05, floor: float = 1e-3) -> Column:
    """struct(low, high) of the difference of two means by Welch's t, its standard error at least `floor`."""

    @F.pandas_udf("low double, high double")
    def of(m1: pd.Series, v1: pd.Series, n1: pd.Series, m2: pd.Series, v2: pd.Series, n2: pd.Series) -> pd.DataFrame:
        m1, v1, n1, m2, v2, n2 = (x.to_numpy(dtype=float) for x in (m1, v1, n1, m2, v2, n2))
        a, b = v1 / n1, v2 / n2
        se = np.maximum(np.sqrt(a + b), floor)
        df = np.maximum((a + b) ** 2 / np.maximum(a**2 / np.maximum(n1 - 1, 1) + b**2 / np.maximum(n2 - 1, 1), 1e-30), 1.0)
        half = t_ppf(1 - alpha / 2, np.minimum(df, 1e6)) * se
        return pd.DataFrame({"low": m1 - m2 - half, "high": m1 - m2 + half})

    return of(mean1, var1, n1, mean2, var2, n2)


def normal_tail(x: Column) -> Column:
    """Chance that a standard normal number is above x."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(1 - normal_cdf(x.to_numpy(dtype=float)))

    return of(x)
