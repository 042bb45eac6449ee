"""Two-sided Student t probabilities, vectorised with numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_TERMS = 20_000


def _log_beta_half(a: np.ndarray) -> np.ndarray:
    """log B(a, 1/2). The gamma ratio is expanded for large ``a``, where lgamma would cancel."""
    unique, where = np.unique(a, return_inverse=True)
    out = np.empty_like(unique)
    for i, v in enumerate(unique):
        if v > 60.0:
            ratio = 0.5 * math.log(v) - 1 / (8 * v) + 1 / (192 * v**3) - 1 / (640 * v**5)
            out[i] = 0.5 * math.log(math.pi) - ratio
        else:
            out[i] = 0.5 * math.log(math.pi) + math.lgamma(v) - math.lgamma(v + 0.5)
    return out[where].reshape(a.shape)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The fraction of the incomplete beta function by the modified Lentz recurrence."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    f = d.copy()
    for m in range(1, _MAX_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        f = f * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        f = f * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return f


def two_sided_p(t, df) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom; NaN where df <= 0 or t is NaN."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    out[np.isinf(t) & (df > 0)] = 0.0
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    tt, d = np.square(t[ok]), df[ok]
    a, half = d / 2.0, np.full(d.shape, 0.5)
    x, rest = d / (d + tt), tt / (d + tt)
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + 0.5 * np.log(rest) - _log_beta_half(a))
    direct = x < (a + 1.0) / (a + 2.5)
    p = np.empty_like(x)
    if direct.any():
        p[direct] = (front * 1.0)[direct] * _continued_fraction(a[direct], half[direct], x[direct]) / a[direct]
    other = ~direct
    if other.any():
        p[other] = 1.0 - front[other] * _continued_fraction(half[other], a[other], rest[other]) / 0.5
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


def _t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value as a column; runs as an Arrow-batched function over result rows."""
    return F.pandas_udf(_t_pvalue, "double")(t.cast("double"), df.cast("double"))
