"""Lookups in small literal tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_lookup(c: Column, table: dict[str, Any]) -> Column:
    """Value of a string in a table, null where it is not in it.

    Costs a walk over the table, so it is for the few words that passed a filter.
    """
    pairs = [F.lit(x) for k in sorted(table) for x in (k, table[k])]
    return F.element_at(F.create_map(*pairs), c)
