"""Two-sided p-values of t statistics, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Lentz's evaluation of the continued fraction of I_x(a, b)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, rounds):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + numerator * d), guard(1 + numerator / c)
            out *= c * d
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b)."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    direct = inside < (a + 1) / (a + b + 2)
    low = front * _fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, inside, 1 - inside)) / np.where(direct, a, b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, low, 1 - low)))


def two_sided(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    t, freedom = np.asarray(t, float), np.asarray(freedom, float)
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & (freedom > 0)
    out[np.isinf(t) & (freedom > 0)] = 0.0
    if ok.any():
        out[ok] = incomplete_beta(freedom[ok] / 2, np.full(int(ok.sum()), 0.5), freedom[ok] / (freedom[ok] + t[ok] ** 2))
    return out


def p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic; null where either is null."""

    @F.arrow_udf("double")
    def p(a: pa.Array, b: pa.Array) -> pa.Array:
        value = two_sided(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
        return pa.array(value, mask=np.isnan(value))

    return p(t.cast("double"), freedom.cast("double"))
