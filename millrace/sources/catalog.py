"""A catalogue of datasets: data as Parquet, one profile row each in a Parquet table."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.select import page
from millrace.schema import col

# A source option whose lower-cased name contains one of these is not stored.
SECRET_NAMES = ["password", "aws_secret_access_key", "aws_access_key_id", "credentials_json",
                "api_key", "token", "secret"]
# The kinds of visibility.
VISIBILITIES = ["private", "public", "shared"]

ENTRY = ("dataset_id string, dataset_name string, description string, owner_id bigint, source_type string, "
         "source_config map<string,string>, path string, row_count bigint, column_count bigint, "
         "column_names array<string>, column_types map<string,string>, sample array<map<string,string>>, "
         "data_quality_score double, pipeline_applied boolean, pipeline_config string, visibility string, "
         "created_at timestamp_ntz")


def without_secrets(options: dict[str, Any] | None) -> dict[str, str]:
    return {str(k): str(v) for k, v in (options or {}).items()
            if not any(name in str(k).lower() for name in SECRET_NAMES)}


class Catalog:
    """Lives in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entries_path(self) -> str:
        return f"{self.root}/entries"

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self._entries_path())

    def register(self, df: DataFrame, name: str, owner_id: int, description: str | None = None,
                 source_type: str = "upload", source_config: dict | None = None, visibility: str = "private",
                 pipeline_config: list | dict | None = None, data_quality_score: float | None = None,
                 save_file: bool = True, dataset_id: str | None = None, created_at: datetime | None = None,
                 order_by: list[str] | None = None) -> str:
        """Writes the data and its profile row; the rows are counted while they are written.

        The sample is the first three rows by `order_by`, or any three.
        """
        if visibility not in VISIBILITIES:
            raise ValueError(f"no such visibility: {visibility}")
        dataset_id = dataset_id or uuid.uuid4().hex[:12]
        path = None
        if save_file:
            path = f"{self.root}/datasets/{dataset_id}.parquet"
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            rows = seen.get["rows"]
            df = self.spark.read.parquet(path)
        else:
            rows = df.count()
        shown = df.orderBy(*[col(c) for c in order_by]) if order_by else df
        sample = [r.asDict() for r in shown.limit(3).select(
            *[col(c).cast("string").alias(c) for c in df.columns]).collect()]
        entry = (dataset_id, name, description, owner_id, source_type, without_secrets(source_config), path, rows,
                 len(df.columns), df.columns, {f.name: f.dataType.simpleString() for f in df.schema.fields}, sample,
                 data_quality_score, pipeline_config is not None,
                 json.dumps(pipeline_config) if pipeline_config is not None else None, visibility,
                 created_at or datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("append").parquet(self._entries_path())
        return dataset_id

    def load(self, dataset_id: str) -> DataFrame:
        row = self.entries().filter(F.col("dataset_id") == dataset_id).select("path").first()
        if row is None or row["path"] is None:
            raise ValueError(f"no dataset {dataset_id}")
        return self.spark.read.parquet(row["path"])

    def _newest(self, df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
        return page(df, [F.desc("created_at"), F.asc("dataset_id")], limit, offset)

    def list_public(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._newest(self.entries().filter("visibility = 'public'"), limit, offset)

    def list_owned(self, owner_id: int, limit: int = 50) -> DataFrame:
        return self._newest(self.entries().filter(F.col("owner_id") == owner_id), limit)

    def search(self, query: str, visibility: str | None = None, limit: int = 20) -> DataFrame:
        """Name or description contains the query, case ignored; no character is a wildcard."""
        wanted = F.lit(query.lower())
        hit = F.contains(F.lower("dataset_name"), wanted) | F.coalesce(
            F.contains(F.lower("description"), wanted), F.lit(False))
        found = self.entries().filter(hit)
        return self._newest(found.filter(F.col("visibility") == visibility) if visibility else found, limit)

    def clone_steps(self, dataset_id: str, user_id: int) -> list | dict | None:
        """The saved steps of a dataset, if the user may see it and it has any."""
        row = self.entries().filter(F.col("dataset_id") == dataset_id).first()
        if row is None or row["pipeline_config"] is None:
            return None
        if row["visibility"] == "private" and row["owner_id"] != user_id:
            return None
        return json.loads(row["pipeline_config"])
