"""Small number helpers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


# The quantiles in use for the usual levels of confidence.
_QUANTILES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def z_of(confidence: float) -> float:
    """Two-sided normal quantile of any confidence between 0 and 1."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    return _QUANTILES.get(confidence) or NormalDist().inv_cdf((1 + confidence) / 2)


def round_to(value: Column | str, digits: int) -> Column:
    """Round a double by scaling, half away from zero: the rounding of the SQL engine whose results
    the KPIs have to match. ``F.round`` rounds the shortest decimal form instead, which differs where
    the double only looks like a tie."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.round(value.cast("double") * scale) / scale


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Division that gives null for a zero divisor."""
    part = F.col(part) if isinstance(part, str) else part
    return part / F.nullif(whole if isinstance(whole, Column) else F.col(whole), F.lit(0))
