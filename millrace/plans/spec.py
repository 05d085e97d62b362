"""Recorded steps: ordered, JSON-serialisable, replayable on any table."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any, Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import millrace.operators.clean       # noqa: F401  the imports fill the step registry
import millrace.operators.cluster     # noqa: F401
import millrace.operators.encode      # noqa: F401
import millrace.operators.forest      # noqa: F401
import millrace.operators.knn         # noqa: F401
import millrace.operators.linalg      # noqa: F401
import millrace.operators.scale       # noqa: F401
import millrace.operators.select      # noqa: F401
import millrace.operators.text        # noqa: F401
from millrace.base import STEPS, Fitted, restore
from millrace.operators.profile import table_of
from millrace.runtime import settle

HISTORY = "step_no int, type string, parameters string, rows bigint, columns int, recorded_at timestamp_ntz"


class StepList:
    """Steps by name and options, not yet fitted."""

    def __init__(self, steps: list[dict[str, Any]], name: str = "", description: str = ""):
        for s in steps:
            if s["type"] not in STEPS:
                raise ValueError(f"Unknown step: {s['type']}")
        self.steps, self.name, self.description = steps, name, description

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "description": self.description, "steps": self.steps})

    @staticmethod
    def from_json(text: str) -> "StepList":
        saved = json.loads(text)
        return StepList(saved["steps"], saved["name"], saved["description"])

    def fit(self, df: DataFrame) -> "FittedSteps":
        """Fits each step on the result of those before it."""
        fitted = []
        for s in self.steps:
            model = STEPS[s["type"]](**s.get("parameters", {})).fit(df)
            fitted.append(model)
            df = model.transform(df)
        return FittedSteps(fitted, self.steps)


class FittedSteps:
    """Fitted steps use the statistics they learnt on whatever table they are given."""

    def __init__(self, fitted: list[Fitted], steps: list[dict[str, Any]]):
        self.fitted, self.steps = fitted, steps

    def transform(self, df: DataFrame) -> DataFrame:
        for model in self.fitted:
            df = model.transform(df)
        return df

    def to_json(self) -> str:
        saved = [m.to_dict() for m in self.fitted]
        if any(s.get("refit") for s in saved):
            raise ValueError("steps that keep a table of rows are saved unfitted, as a StepList")
        return json.dumps({"steps": self.steps, "fitted": saved})

    @staticmethod
    def from_json(text: str) -> "FittedSteps":
        saved = json.loads(text)
        return FittedSteps([restore(s) for s in saved["fitted"]], saved["steps"])

    def history(self, df: DataFrame, at: datetime | None = None) -> DataFrame:
        """One row per step with the size of the table after it."""
        at = at or datetime.now(timezone.utc).replace(tzinfo=None)
        rows = []
        for i, (model, s) in enumerate(zip(self.fitted, self.steps)):
            df = model.transform(df)
            rows.append((i + 1, s["type"], json.dumps(s.get("parameters", {}), sort_keys=True),
                         df.count(), len(df.columns), at))
        return table_of(df, rows, HISTORY)


def map_batches(df: DataFrame, function: Callable, schema, batch_size: int = 1000) -> DataFrame:
    """A pandas function over batches of at most `batch_size` rows, results put together."""

    def run(batches: Iterator):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                yield function(pdf.iloc[start:start + batch_size])

    return df.mapInPandas(run, schema)
