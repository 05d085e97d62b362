"""Rows and bytes of an Arrow batch for operators on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1000
BYTES = 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df` itself, in a session whose batches hold at most ROWS rows and BYTES bytes (or one row): texts are long, and a
    worker holds a whole batch. Lower limits of the session stay as they are."""
    conf = df.sparkSession.conf
    for setting, most in _LIMITS.items():
        if not 0 < int(conf.get(setting).rstrip("b")) <= most:
            conf.set(setting, str(most))
    return df
