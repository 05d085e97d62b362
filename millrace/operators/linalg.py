"""Covariance, eigenvalues, principal components and singular values.

Spark adds up the d x d moments; only that matrix reaches the driver, where it
is decomposed. Projections are plain column arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.base import Step, step
from millrace.operators.moments import pair_moments
from millrace.operators.profile import table_of
from millrace.operators.scale import _filled_spread, filled
from millrace.runtime import agg_rows
from millrace.schema import col, dbl


def _numeric(df, columns, purpose):
    columns = S.numeric(df) if columns is None else columns
    if not columns:
        raise ValueError(f"{purpose} needs at least one numeric column")
    return columns


def covariance_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sample covariance over complete pairs, as (row_col, col_col, value)."""
    columns = _numeric(df, columns, "covariance calculation")
    moments = pair_moments(df, columns)
    return table_of(df, [(a, b, moments.covariance(a, b)) for a in columns for b in columns],
                    "row_col string, col_col string, value double")


def decompose(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from large to small and their vectors (as columns).

    The entry of largest magnitude of each vector is made positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def _complete(moments) -> np.ndarray:
    if np.isnan(moments.cov).any():
        raise ValueError("a pair of columns has under two rows with both values")
    return moments.cov


def eigen_decomposition(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (component, eigenvalue, explained_ratio, cumulative), component from 1."""
    values, _ = decompose(_complete(pair_moments(df, _numeric(df, columns, "eigenvalues"))))
    share = values / values.sum()
    total = np.cumsum(share)
    return table_of(df, [(i + 1, float(values[i]), float(share[i]), float(total[i])) for i in range(len(values))],
                    "component int, eigenvalue double, explained_ratio double, cumulative double")


def eigenvectors(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = _numeric(df, columns, "eigenvectors")
    _, vectors = decompose(_complete(pair_moments(df, columns)))
    return table_of(df, [(i + 1, c, float(vectors[j, i])) for i in range(len(columns)) for j, c in enumerate(columns)],
                    "component int, column string, loading double")


def _dot(terms: list[tuple[Column, float]]) -> Column:
    """Weighted sum as a balanced tree, so that many terms do not nest deeply."""
    parts = [c * F.lit(float(w)) for c, w in terms]
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


# Products written out as column arithmetic; more would outgrow the generated code.
MAX_TERMS = 256


def _multiply(columns: list[Column], loadings: list[list[float]]) -> Column:
    """All components of a batch by one matrix product."""
    weights = np.array(loadings).T

    @F.pandas_udf("array<double>")
    def product(*values: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack([v.to_numpy(dtype=float) for v in values]) @ weights))

    return product(*columns)


class Projection(Step):
    """Replaces the numeric columns by components; the other columns pass through."""

    prefix = ""

    @classmethod
    def defaults(cls):
        return {"n_components": 2, "columns": None, "exclude": None, "prefix": None}

    def columns(self, df):
        columns = self.options["columns"] or S.numeric(df, tuple(self.options["exclude"] or ()))
        return _numeric(df, columns, self.name)

    @staticmethod
    def project(df, params):
        used = params["columns"]
        # Centred once, in a projection of its own, and used by every component.
        centred = df.withColumns({c: (filled(c, params["mean"][c]) - params["mean"][c]) / params["scale"][c]
                                  for c in used})
        keep = [col(c) for c in df.columns if c not in used]
        names = [f"{params['prefix']}{i + 1}" for i in range(len(params["loadings"]))]
        if len(used) * len(names) > MAX_TERMS:
            return centred.select(*keep, _multiply([col(c) for c in used], params["loadings"]).alias("__s")).select(
                *keep, *[F.get("__s", F.lit(i)).alias(n) for i, n in enumerate(names)])
        new = [_dot([(col(c), w) for c, w in zip(used, weights)]).alias(n)
               for n, weights in zip(names, params["loadings"])]
        return centred.select(*keep, *new)


@step("pca")
class Pca(Projection):
    """Centred projection on the leading eigenvectors of the covariance; nulls are an error."""

    def learn(self, df):
        columns = self.columns(df)
        got = agg_rows(df, [F.count(F.lit(1))] + [e for c in columns for e in (F.count(dbl(c)), F.avg(dbl(c)))])
        if any(n != got[0] for n in got[1::2]):
            raise ValueError("PCA needs complete columns; impute the missing values first")
        means = dict(zip(columns, got[2::2]))
        k = min(self.options["n_components"], len(columns))
        values, vectors = decompose(_complete(pair_moments(df, columns)))
        share = values / values.sum()
        return {"columns": columns, "mean": means, "scale": {c: 1.0 for c in columns},
                "loadings": vectors[:, :k].T.tolist(), "prefix": self.options["prefix"] or "PC",
                "explained_variance": values[:k].tolist(), "explained_variance_ratio": share[:k].tolist()}

    @staticmethod
    def apply(df, params):
        return Projection.project(df, params)

    def describe(self, params):
        return {"explained_variance": params["explained_variance"],
                "explained_variance_ratio": params["explained_variance_ratio"],
                "cumulative_variance": np.cumsum(params["explained_variance_ratio"]).tolist(),
                "n_components": len(params["loadings"])}


@step("svd")
class Svd(Projection):
    """U * s of the mean-filled, standardised table."""

    def learn(self, df):
        columns = self.columns(df)
        spread = _filled_spread(df, columns)
        rows = next(iter(spread.values()))["rows"]
        means = {c: f["mean"] if f["mean"] is not None else 0.0 for c, f in spread.items()}
        scale = {c: f["std_pop"] or 1.0 for c, f in spread.items()}
        full = df.select(*[filled(c, means[c]).alias(c) for c in columns])
        cov = np.nan_to_num(pair_moments(full, columns).cov) * (rows - 1)
        s = np.array([scale[c] for c in columns])
        squares, vectors = decompose(cov / np.outer(s, s))
        squares = np.clip(squares, 0.0, None)
        k = min(self.options["n_components"], len(columns), rows)
        return {"columns": columns, "mean": means, "scale": scale, "loadings": vectors[:, :k].T.tolist(),
                "prefix": self.options["prefix"] or "SVD", "singular_values": np.sqrt(squares[:k]).tolist(),
                "cumulative_variance": np.cumsum(squares[:k] / squares.sum()).tolist()}

    @staticmethod
    def apply(df, params):
        return Projection.project(df, params)

    def describe(self, params):
        return {k: params[k] for k in ("singular_values", "cumulative_variance")}
