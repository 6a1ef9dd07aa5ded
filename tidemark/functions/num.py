"""Numbers: rounding half up on the double product, guards for what is not finite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jround(x: Column, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits, so -0.5 gives 0; F.round rounds the decimal text instead."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def safe(x: Column) -> Column:
    """0 for null, NaN and the infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    """Between low and high; what is not finite becomes low."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))

