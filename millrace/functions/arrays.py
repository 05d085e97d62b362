"""Positions and best entries of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """1-based position of the first largest entry."""
    return F.array_position(a, F.array_max(a)).cast("int")


def top_positions(a: Column, n: int) -> Column:
    """1-based positions of the n largest entries, largest first, ties by position."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("v"), (i + 1).alias("at"))))
    return F.transform(F.slice(ranked, 1, n), lambda e: e["at"].cast("int"))
