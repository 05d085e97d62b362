"""Preview and the bundle of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.operators import profile as P
from millrace.operators.compare import before_after
from millrace.operators.select import head
from millrace.plans.health import analyze, column_types, quality_table


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> dict[str, DataFrame]:
    """Shape, types with null counts, statistics, and the first rows in printed form."""
    rows, nulls = P.null_tally(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {
        "shape": P.table_of(df, [(rows, len(df.columns))], "rows bigint, columns int"),
        "columns": P.table_of(df, [(i + 1, c, types[c], nulls[c]) for i, c in enumerate(df.columns)],
                              "position int, column string, type string, null_count bigint"),
        "statistics": P.numeric_statistics(df),
        "rows": head(df, order_by, n, as_text=True),
    }


def report_bundle(df: DataFrame, out: str, name: str, before: DataFrame | None = None,
                  steps: list[dict] | None = None, description: str | None = None) -> dict[str, str]:
    """Writes the report's tables under a folder; returns the paths by table."""
    health = analyze(df)
    tables = {
        "about": P.table_of(df, [(name, description or f"Analysis report for {name}", health.rows, len(df.columns))],
                            "report_name string, description string, rows bigint, columns int"),
        "types": column_types(df),
        "nulls": P.null_counts(df),
        "duplicates": P.table_of(df, [(health.duplicates, health.duplicates / max(health.rows, 1) * 100)],
                                 "duplicates bigint, duplicate_pct double"),
        "quality": quality_table(df, health),
    }
    if health.numeric:
        tables["statistics"] = P.numeric_statistics(df)
        tables["histograms"] = P.histogram(df)
        tables["correlations"] = P.correlation_matrix(df, S.numeric(df)[:5])
    if S.cat_encode(df):
        tables["top_values"] = P.top_values(df)
        tables["distinct"] = P.distinct_counts(df, S.cat_encode(df))
        tables["modes"] = P.modes(df)
    if before is not None:
        tables["before_after"] = before_after(before, df)
    if steps:
        import json

        tables["steps"] = P.table_of(df, [(i + 1, s["type"], json.dumps(s.get("parameters", {})))
                                          for i, s in enumerate(steps)], "step_no int, type string, parameters string")
    paths = {}
    for t, table in tables.items():
        paths[t] = f"{out.rstrip('/')}/{t}"
        table.write.mode("overwrite").parquet(paths[t])
    return paths
