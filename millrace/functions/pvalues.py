"""Tail probabilities for the few result rows of a test (never for the rows of a table)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b), by its continued fraction (Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def t_two_sided(t: float, df: float) -> float:
    if df is None or t is None or math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if f is None or math.isnan(f) or math.isnan(df1) or math.isnan(df2):
        return math.nan
    if math.isinf(f):
        return 0.0
    return beta_tail(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(ts, dfs)], dtype=float)

    return F.nanvl(p(t, df), F.lit(None).cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def p(fs: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_upper(x, y, z) for x, y, z in zip(fs, a, b)], dtype=float)

    return F.nanvl(p(f, df1, df2), F.lit(None).cast("double"))
