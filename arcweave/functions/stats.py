"""Scalar helpers: IEEE division as a column, quantiles, log-space sums, distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))



def fdiv(a: Column | str, b: Column | str) -> Column:
    """a / b in IEEE arithmetic: 0/0 is NaN, x/0 is a signed infinity (ANSI mode would raise)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), nan()).otherwise(F.signum(a) * inf())


def quantile(values, q: float) -> float:
    """Linear interpolation between order statistics (type 7)."""
    v = np.asarray(values, float)
    return float(np.quantile(v, q)) if len(v) else math.nan


def log_sum(values) -> float | None:
    """log(sum(exp(values))), stable; None for no values."""
    v = np.asarray(values, float)
    if not len(v):
        return None
    top = v.max()
    return float(top) if not np.isfinite(top) else float(top + np.log(np.exp(v - top).sum()))


def log_mean(values) -> float | None:
    total = log_sum(values)
    return None if total is None else total - math.log(len(values))


def log_sub(x, y) -> np.ndarray:
    """log(exp(x) - exp(y)) by element: NaN where x < y, -inf where equal."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    with np.errstate(all="ignore"):
        return np.where(x < y, np.nan, np.where(x == y, -np.inf, x + np.log1p(-np.exp(y - x))))


def log_sum_column(value: Column | str, over) -> Column:
    """Window form of ``log_sum``."""
    v = F.col(value) if isinstance(value, str) else value
    top = F.max(v).over(over)
    return top + F.log(F.sum(F.exp(v - top)).over(over))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def rng(seed, *key: int) -> np.random.Generator:
    """Counter-based generator that depends on the seed and the key only, not on partitions."""
    base = seed if isinstance(seed, int) else int.from_bytes(str(seed).encode()[:16].ljust(16, b"\0"), "little")
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([base & ((1 << 64) - 1), *key])))
