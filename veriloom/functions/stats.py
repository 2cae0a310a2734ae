"""Tail probabilities of test statistics, for short result tables.

Every function takes plain floats; ``p_value_udf`` wraps one as a pandas UDF for
frames with one row per test.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# These functions run in Python workers; send them along instead of expecting the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-15
_TINY = 1e-300


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    frac = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or _TINY)
        c = b + step / c or _TINY
        frac *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return frac * math.exp(log_front)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz evaluation of the continued fraction
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or _TINY)
        c = 1 + num / c or _TINY
        f *= c * d
        if abs(1 - c * d) < _EPS:
            break
    return front * (f - 1)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_sf2(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_sf2(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def kolmogorov_sf(lam: float) -> float:
    """Asymptotic p-value of the Kolmogorov-Smirnov statistic, lam = D sqrt(n1 n2 / (n1 + n2))."""
    if lam < 1e-3:
        return 1.0
    if lam < 1.18:
        y = math.exp(-math.pi ** 2 / (8 * lam * lam))
        return 1.0 - math.sqrt(2 * math.pi) / lam * (y + y ** 9 + y ** 25 + y ** 49)
    return max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 20)))


def p_value_udf(fn):
    """Pandas UDF of one of the functions above; null or NaN arguments give null."""

    @F.pandas_udf("double")
    def apply(frame: pd.DataFrame) -> pd.Series:
        def one(row):
            args = [float(v) if v is not None else math.nan for v in row]
            return None if any(math.isnan(a) for a in args) else fn(*args)
        return pd.Series([one(r) for r in frame.itertuples(index=False, name=None)], dtype="float64")

    return lambda *cols: apply(F.struct(*cols))
