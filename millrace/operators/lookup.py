"""Join rows to a table of per-value facts, safe against hot values.

A lookup table has one row per value. If a job shows it to be small it is
broadcast. If not, the values that hold more than one row in a thousand (at
most a thousand of them) are looked up by broadcast, and only the remaining
values, none of which is hot, go through a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import is_small, shuffled_join
from millrace.schema import col

HOT_SHARE = 1000


def lookup_join(df: DataFrame, table: DataFrame, key: str, weight: str, total: int,
                small: bool | None = None) -> DataFrame:
    """Left join of `df` with `table` on `key`; `weight` counts the rows per value.

    `table` holds `key`, `weight` and the columns to add; `weight` is not added.
    """
    facts = [c for c in table.columns if c not in (key, weight)]
    if is_small(table) if small is None else small:
        return df.join(F.broadcast(table.drop(weight)), key, "left")
    hot = table.filter(col(weight) * HOT_SHARE > total).drop(weight).withColumn("__hot", F.lit(True))
    cold = table.filter(col(weight) * HOT_SHARE <= total).drop(weight)
    # `hot` has under HOT_SHARE rows, since its weights add up to at most `total`.
    marked = df.join(F.broadcast(hot), key, "left")
    done = marked.filter("__hot").drop("__hot")
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot", *facts)
    return done.unionByName(shuffled_join(rest, cold, key, "left"))
