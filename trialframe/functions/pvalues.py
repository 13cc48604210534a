"""Tail probabilities. Closed forms stay in the JVM; the rest are vectorised Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    """Complementary error function of x >= 0: a series of positive terms, beyond 2.5 a continued fraction."""
    v = x.to_numpy(float)
    near = np.clip(v, 0, 2.5)
    term = total = 2 / math.sqrt(math.pi) * np.exp(-near * near) * near
    for n in range(1, 60):
        term = term * 2 * near * near / (2 * n + 1)
        total = total + term
    far = np.maximum(v, 2.5)
    tail = far
    for k in range(80, 0, -1):
        tail = far + k / 2 / tail
    return pd.Series(np.where(v > 2.5, np.exp(-far * far) / math.sqrt(math.pi) / tail, np.where(np.isnan(v), np.nan, 1 - total)))


def chi2_sf(h: Column, df: Column) -> Column:
    """Chi-square upper tail for one or two degrees of freedom."""
    two = F.exp(-h / 2)
    one = _erfc(F.when((df == 1) & h.isNotNull(), F.sqrt(F.greatest(h, F.lit(0.0)) / 2)))
    return F.when(df == 2, two).when(df == 1, one)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, element-wise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, steps):
            for num in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                delta = c * d
                f = f * delta
            if np.nanmax(np.abs(delta - 1), initial=0) < 1e-15:
                break
    value = np.where(y <= 0, 0.0, front * f)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(DoubleType())
def _t_two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    rho, dof = r.to_numpy(float), n.to_numpy(float) - 2
    ok = np.isfinite(rho) & (dof > 0)
    out = np.full(len(rho), np.nan)
    if ok.any():
        # dof / (dof + t^2) equals 1 - rho^2
        out[ok] = incomplete_beta(dof[ok] / 2, 0.5, np.clip(1 - rho[ok] ** 2, 0, 1))
    return pd.Series(out)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided t-test p of a rank correlation over n pairs."""
    p = _t_two_sided(rho.cast("double"), n.cast("double"))
    return F.nanvl(p, F.lit(None).cast("double"))
