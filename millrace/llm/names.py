"""Names for helper columns beside those of a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """`names`, each with as many underscores before it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return tuple(out)
