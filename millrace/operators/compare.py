"""Two tables side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.functions.numbers import finite
from millrace.operators.profile import duplicate_count, null_tally, table_of
from millrace.operators.select import head
from millrace.schema import col, dbl


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (metric, before, after, change) for rows, columns, nulls and duplicates.

    The change of nulls and duplicates is the reduction, that of rows and columns the growth.
    """
    facts = []
    for df in (before, after):
        rows, nulls = null_tally(df)
        facts.append({"rows": rows, "columns": len(df.columns), "missing_values": sum(nulls.values()),
                      "duplicates": duplicate_count(df)})
    b, a = facts
    rows = [(m, b[m], a[m], a[m] - b[m] if m in ("rows", "columns") else b[m] - a[m]) for m in b]
    return table_of(before, rows, "metric string, before bigint, after bigint, change bigint")


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (column, in_before, in_after); from the schemas alone."""
    names = list(dict.fromkeys(before.columns + after.columns))
    return table_of(before, [(c, c in before.columns, c in after.columns) for c in names],
                    "column string, in_before boolean, in_after boolean")


def side_by_side(before: DataFrame, after: DataFrame, order_by: list[str], limit: int = 1000) -> DataFrame:
    """The first rows of both with a `side` column: the order columns and the common numerics."""
    if not 50 <= limit <= 5000:
        raise ValueError("limit must be from 50 to 5000")
    numeric = [c for c in S.numeric(before) if c in S.numeric(after) and c not in order_by]

    def part(df, side):
        rows = head(df, order_by, limit)
        return rows.select(F.lit(side).alias("side"), *[col(c) for c in order_by],
                           *[finite(dbl(c)).alias(c) for c in numeric])

    return part(before, "before").unionByName(part(after, "after"))
