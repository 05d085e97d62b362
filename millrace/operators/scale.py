"""Scaling and monotone transforms of numeric columns.

All but winsorising-style steps fill missing values with the column mean first.
Columns outside `columns` (default: all numerics but `exclude`) pass through.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.base import Step, step
from millrace.functions.numbers import clip
from millrace.operators.profile import base_facts
from millrace.operators.quantiles import percentiles
from millrace.schema import col, dbl


def chosen(df: DataFrame, options: dict, purpose: str) -> list[str]:
    """Numeric columns a step works on; an error when there are none."""
    columns = options["columns"]
    if columns is None:
        columns = S.numeric(df, tuple(options["exclude"] or ()))
    S.require(df, columns)
    if not columns:
        raise ValueError(f"{purpose} needs at least one numeric column")
    return columns


def filled(name: str, mean: float | None) -> Column:
    """Value as double, missing ones replaced by the mean if there is one."""
    return dbl(name) if mean is None else F.coalesce(dbl(name), F.lit(float(mean)))


class NumericStep(Step):
    purpose = "this step"

    @classmethod
    def defaults(cls):
        return {"columns": None, "exclude": None, **cls.extra()}

    @classmethod
    def extra(cls):
        return {}

    def learn(self, df):
        columns = chosen(df, self.options, self.purpose)
        return {"columns": {c: p for c, p in self.learn_columns(df, columns).items()}}

    def learn_columns(self, df, columns) -> dict[str, dict]:
        raise NotImplementedError

    @classmethod
    def value(cls, name: str, p: dict) -> Column:
        raise NotImplementedError

    @classmethod
    def project(cls, df, params):
        return df.withColumns({c: cls.value(c, p) for c, p in params["columns"].items()})


def numeric_step(name: str):
    """Register a numeric step; `apply` is its projection."""

    def enter(cls):
        cls.apply = staticmethod(lambda df, params: cls.project(df, params))
        return step(name)(cls)

    return enter


@numeric_step("standardization")
class Standardize(NumericStep):
    """(x - mean) / population std; a constant column becomes 0."""

    purpose = "standardization"

    def learn_columns(self, df, columns):
        return {c: {"mean": f["mean"], "std": f["std_pop"]}
                for c, f in _filled_spread(df, columns).items()}

    @classmethod
    def value(cls, name, p):
        if p["mean"] is None:
            return dbl(name)
        return (filled(name, p["mean"]) - p["mean"]) / (p["std"] or 1.0)


def _filled_spread(df, columns) -> dict[str, dict]:
    """Mean and population std after mean filling, in one job.

    Filling with the mean adds rows of deviation 0, so the sum of squares stays
    and only the count grows.
    """
    from millrace.runtime import agg_rows

    exprs = [F.count(F.lit(1))]
    for c in columns:
        exprs += [F.count(col(c)), F.avg(col(c)), F.stddev_pop(col(c)), F.min(col(c)), F.max(col(c))]
    got = agg_rows(S.doubles(df, columns), exprs)
    rows = got[0]
    out = {}
    for i, c in enumerate(columns):
        n, mean, std, low, high = got[1 + 5 * i:6 + 5 * i]
        if n and low == high:  # a constant has no spread, whatever rounding leaves of the sums
            mean, std = low, 0.0
        out[c] = {"mean": mean, "count": n, "rows": rows,
                  "std_pop": std * (n / rows) ** 0.5 if n else None}
    return out


@numeric_step("min_max")
class MinMax(NumericStep):
    """Linear map of [min, max] to `low`..`high`; a constant column becomes `low`."""

    purpose = "normalization"

    @classmethod
    def extra(cls):
        return {"low": 0.0, "high": 1.0}

    def learn_columns(self, df, columns):
        if not self.options["low"] < self.options["high"]:
            raise ValueError("low must be below high")
        span = {"low": float(self.options["low"]), "high": float(self.options["high"])}
        return {c: {"mean": f["mean"], "min": f["min"], "max": f["max"], **span}
                for c, f in base_facts(df, columns).items()}

    @classmethod
    def value(cls, name, p):
        if p["min"] is None:
            return dbl(name)
        factor = (p["high"] - p["low"]) / ((p["max"] - p["min"]) or 1.0)
        return (filled(name, p["mean"]) - p["min"]) * factor + p["low"]


@numeric_step("robust_scaling")
class RobustScale(NumericStep):
    """(x - median) / interquartile range; no spread counts as 1."""

    purpose = "robust scaling"

    def learn_columns(self, df, columns):
        means, full, counts = _mean_filled(df, columns)
        quartiles = percentiles(full, columns, [0.25, 0.5, 0.75], counts)
        return {c: {"mean": means[c], "center": q[1], "scale": (q[2] - q[0]) or 1.0 if q[1] is not None else None}
                for c, q in quartiles.items()}

    @classmethod
    def value(cls, name, p):
        if p["center"] is None:
            return dbl(name)
        return (filled(name, p["mean"]) - p["center"]) / p["scale"]


def _mean_filled(df, columns):
    """Means, the mean-filled table, and its values per column."""
    spread = _filled_spread(df, columns)
    means = {c: f["mean"] for c, f in spread.items()}
    counts = {c: f["rows"] if f["count"] else 0 for c, f in spread.items()}
    return means, df.select(*[filled(c, means[c]).alias(c) for c in columns]), counts


@numeric_step("quantile_transformation")
class QuantileTransform(NumericStep):
    """Rank in a grid of exact quantiles, by linear interpolation; uniform or normal output.

    Where values tie on the grid, the mean of the lowest and highest rank is taken.
    """

    purpose = "quantile transformation"
    EDGE = 1e-7

    @classmethod
    def extra(cls):
        return {"n_quantiles": 100, "output_distribution": "uniform"}

    def learn_columns(self, df, columns):
        if self.options["output_distribution"] not in ("uniform", "normal"):
            raise ValueError("output_distribution must be uniform or normal")
        means, full, counts = _mean_filled(df, columns)
        rows = max(counts.values(), default=0)
        n = min(self.options["n_quantiles"], max(10, rows))
        n = max(1, min(n, rows))  # a grid finer than the rows adds nothing
        probs = [i / (n - 1) for i in range(n)] if n > 1 else [0.0]
        grids = percentiles(full, columns, probs, counts)
        return {c: {"mean": means[c], "grid": grids[c], "normal": self.options["output_distribution"] == "normal"}
                for c in columns}

    @classmethod
    def value(cls, name, p):
        x = filled(name, p["mean"])
        if p["mean"] is None:
            return x
        rank = _grid_rank(p["grid"])
        return _normal(rank(x)) if p["normal"] else rank(x)


def _grid_rank(grid: list[float]):
    """Vectorised rank in a grid; the grid travels with the function, as it is small."""
    values = np.asarray(grid, dtype=float)
    refs = np.linspace(0.0, 1.0, len(values))

    @F.pandas_udf("double")
    def rank(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        up = np.interp(v, values, refs)
        down = -np.interp(-v, -values[::-1], -refs[::-1])
        out = 0.5 * (up + down)
        out[v == values[0]] = 0.0
        out[v == values[-1]] = 1.0
        return pd.Series(np.where(np.isnan(v), np.nan, out))

    return rank


def _normal(share: Column) -> Column:
    bound = NormalDist().inv_cdf(1 - QuantileTransform.EDGE)

    @F.pandas_udf("double")
    def to_normal(u: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return u.map(lambda q: -bound if q <= QuantileTransform.EDGE
                     else bound if q >= 1 - QuantileTransform.EDGE else inverse(q))

    return to_normal(share)


LOG_METHODS = {"log": F.ln, "log10": F.log10, "log2": F.log2}
LOG_FLOOR = 1e-10


@numeric_step("log_power")
class LogPower(NumericStep):
    """log, log10 or log2 of values raised to at least 1e-10, or a power."""

    purpose = "log and power transforms"

    @classmethod
    def extra(cls):
        return {"method": "log", "power": 2.0}

    def learn_columns(self, df, columns):
        method = self.options["method"]
        if method not in (*LOG_METHODS, "power"):
            raise ValueError(f"Unknown method: {method}")
        return {c: {"mean": f["mean"], "method": method, "power": float(self.options["power"])}
                for c, f in base_facts(df, columns).items()}

    @classmethod
    def value(cls, name, p):
        x = filled(name, p["mean"])
        if p["method"] == "power":
            return F.pow(x, F.lit(p["power"]))
        return LOG_METHODS[p["method"]](clip(x, low=LOG_FLOOR))


@numeric_step("skew_log")
class SkewLog(NumericStep):
    """log(1 + x) of skewed columns, moved to start at 1 where they are not positive."""

    purpose = "skew correction"

    @classmethod
    def extra(cls):
        return {"threshold": 1.0}

    def learn_columns(self, df, columns):
        return {c: {"min": f["min"]} for c, f in base_facts(df, columns).items()
                if abs(f["skew"] or 0.0) >= self.options["threshold"]}

    @classmethod
    def value(cls, name, p):
        from millrace.functions.numbers import log1p_shifted

        return log1p_shifted(dbl(name), p["min"])


@numeric_step("winsorization")
class Winsorize(NumericStep):
    """Clip to two quantiles; missing values stay missing."""

    purpose = "winsorization"

    @classmethod
    def extra(cls):
        return {"lower": 0.01, "upper": 0.99}

    def learn_columns(self, df, columns):
        low, high = self.options["lower"], self.options["upper"]
        if not 0 <= low < high <= 1:
            raise ValueError("lower and upper are shares, lower below upper")
        return {c: {"low": q[0], "high": q[1]} for c, q in percentiles(df, columns, [low, high]).items()}

    @classmethod
    def value(cls, name, p):
        return clip(dbl(name), p["low"], p["high"])

    @staticmethod
    def changed(df: DataFrame, params: dict) -> dict[str, int]:
        """Values the limits really change, per column."""
        from millrace.runtime import agg_rows

        flags = [F.count_if((dbl(c) < F.lit(p["low"])) | (dbl(c) > F.lit(p["high"])))
                 for c, p in params["columns"].items()]
        return dict(zip(params["columns"], agg_rows(df, flags)))


@numeric_step("iqr_outliers")
class IqrTreatment(NumericStep):
    """Clip to the quartile fences, or remove rows outside any of them."""

    purpose = "IQR outlier treatment"

    @classmethod
    def extra(cls):
        return {"factor": 1.5, "action": "cap"}

    def learn_columns(self, df, columns):
        f = self.options["factor"]
        out = {}
        for c, (q1, q3) in percentiles(df, columns, [0.25, 0.75]).items():
            if q1 is not None:
                out[c] = {"low": q1 - f * (q3 - q1), "high": q3 + f * (q3 - q1), "action": self.options["action"]}
        return out

    @classmethod
    def value(cls, name, p):
        return clip(dbl(name), p["low"], p["high"])

    @staticmethod
    def flagged(params: dict) -> Column:
        from millrace.operators.profile import outside

        flag = F.lit(False)
        for c, p in params["columns"].items():
            flag = flag | outside(c, (p["low"], p["high"]))
        return flag

    @classmethod
    def project(cls, df, params):
        actions = {p["action"] for p in params["columns"].values()}
        if "remove" in actions:
            return df.filter(~cls.flagged(params))
        return super().project(df, params) if "cap" in actions else df


@numeric_step("mean_fill")
class FillNumeric(NumericStep):
    """Missing numerics by the column mean or median; an empty column stays empty."""

    purpose = "filling"

    @classmethod
    def extra(cls):
        return {"method": "mean"}

    def learn_columns(self, df, columns):
        if self.options["method"] == "median":
            return {c: {"value": q[0]} for c, q in percentiles(df, columns, [0.5]).items()}
        if self.options["method"] != "mean":
            raise ValueError(f"Unknown method: {self.options['method']}")
        return {c: {"value": f["mean"]} for c, f in base_facts(df, columns).items()}

    @classmethod
    def value(cls, name, p):
        return filled(name, p["value"])


@numeric_step("infinity_to_null")
class InfinityToNull(NumericStep):
    purpose = "infinite values"

    def learn_columns(self, df, columns):
        return {c: {} for c in columns}

    @classmethod
    def value(cls, name, p):
        from millrace.functions.numbers import finite

        return finite(dbl(name))
