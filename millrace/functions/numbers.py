"""Numeric column helpers that let a missing value stay missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def log1p_shifted(c: Column, lowest: float) -> Column:
    """log(1 + x), x first moved so that its smallest value is 1 if it is not positive."""
    return F.log1p(c - F.lit(lowest) + 1.0 if lowest <= 0 else c)


def finite(c: Column) -> Column:
    """Infinite values become null."""
    return F.when(F.abs(c) != F.lit(float("inf")), c)
