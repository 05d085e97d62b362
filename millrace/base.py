"""Steps learn in `fit` and act in `transform`.

`Step.fit(df)` runs the aggregate jobs and returns a `Fitted`, whose `params`
are small and JSON-serialisable. `Fitted.transform(df)` runs no job: it is a
projection, a filter or a join, so it also works on a streaming DataFrame.
"""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import DataFrame

STEPS: dict[str, type["Step"]] = {}


class Fitted:
    def __init__(self, name: str, params: dict[str, Any],
                 apply: Callable[[DataFrame, dict[str, Any]], DataFrame],
                 metadata: dict[str, Any] | None = None):
        self.name = name
        self.params = params
        self.metadata = metadata or {}
        self._apply = apply

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.params)

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.name, "params": self.params}


class Step:
    """Base of all steps; subclasses set `name` and give `learn` and `apply`."""

    name = ""
    # Names of the constructor parameters, for saving and replaying a step.
    def __init__(self, **options: Any):
        unknown = set(options) - set(self.defaults())
        if unknown:
            raise ValueError(f"{self.name}: unknown options {sorted(unknown)}")
        self.options = {**self.defaults(), **options}

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {}

    def learn(self, df: DataFrame) -> dict[str, Any]:
        return {}

    @staticmethod
    def apply(df: DataFrame, params: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def describe(self, params: dict[str, Any]) -> dict[str, Any]:
        return {}

    def fit(self, df: DataFrame) -> Fitted:
        params = self.learn(df)
        return Fitted(self.name, params, type(self).apply, self.describe(params))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def step(name: str):
    """Class decorator: enter a step in the registry under its public name."""

    def enter(cls: type[Step]) -> type[Step]:
        cls.name = name
        STEPS[name] = cls
        return cls

    return enter


def restore(saved: dict[str, Any]) -> Fitted:
    """A fitted step from what `Fitted.to_dict` saved."""
    cls = STEPS[saved["type"]]
    return Fitted(saved["type"], saved["params"], cls.apply)
