"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.sources.dialect import CSV_WRITE


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """CSV with a header row, or Parquet; one file per task, no index column."""
    if fmt == "csv":
        df.write.mode(mode).options(**CSV_WRITE).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {fmt}")
