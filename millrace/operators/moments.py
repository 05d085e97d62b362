"""Pairwise second moments over the rows where both values are present.

Each Arrow batch is centred and multiplied in numpy, and Spark adds up the d x d partials. Least and greatest values go
along, so that a column that is constant over the complete pairs has no spread, whatever rounding leaves of the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import agg_rows
from millrace.schema import col, doubles

@dataclass
class PairMoments:
    columns: list[str]
    cov: np.ndarray    # sample covariance, nan where under two complete pairs
    corr: np.ndarray

    def covariance(self, a: str, b: str) -> float | None:
        return self._at(self.cov, a, b)

    def correlation(self, a: str, b: str) -> float | None:
        return self._at(self.corr, a, b)

    def _at(self, matrix, a, b):
        v = float(matrix[self.columns.index(a), self.columns.index(b)])
        return v if math.isfinite(v) else None


def pair_moments(df: DataFrame, columns: list[str]) -> PairMoments:
    d = len(columns)
    centre = np.array([m if m is not None else 0.0 for m in agg_rows(doubles(df, columns), [F.avg(col(c)) for c in columns])])

    def partials(batches):
        n, s, ss, p = (np.zeros((d, d)) for _ in range(4))
        low, high = np.full((d, d), np.inf), np.full((d, d), -np.inf)
        for pdf in batches:
            raw = pdf.to_numpy(dtype=float)
            if not len(raw):
                continue
            here = ~np.isnan(raw)
            x = np.where(here, raw - centre, 0.0)
            m = here.astype(float)
            n += m.T @ m
            s += x.T @ m
            ss += (x * x).T @ m
            p += x.T @ x
            if here.all():
                low, high = np.minimum(low, raw.min(axis=0)[:, None]), np.maximum(high, raw.max(axis=0)[:, None])
            else:
                for j in range(d):  # extremes of all columns over the rows where column j is present
                    part = raw[here[:, j]]
                    if len(part):
                        low[:, j] = np.fmin(low[:, j], np.where(np.isnan(part), np.inf, part).min(axis=0))
                        high[:, j] = np.fmax(high[:, j], np.where(np.isnan(part), -np.inf, part).max(axis=0))
        i, j = np.indices((d, d))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": n.ravel(), "s": s.ravel(), "t": s.T.ravel(),
                            "ss": ss.ravel(), "tt": ss.T.ravel(), "p": p.ravel(), "low": low.ravel(), "high": high.ravel(),
                            "low2": low.T.ravel(), "high2": high.T.ravel()})

    sums, lows, highs = ("n", "s", "t", "ss", "tt", "p"), ("low", "low2"), ("high", "high2")
    rows = (doubles(df, columns).toDF(*[f"x{i}" for i in range(d)])
            .mapInPandas(partials, "i int, j int, " + ", ".join(f"{k} double" for k in (*sums, "low", "high", "low2", "high2")))
            .groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in lows],
                                   *[F.max(k).alias(k) for k in highs]).collect())
    cov, corr = np.full((d, d), np.nan), np.full((d, d), np.nan)
    for r in rows:
        n = r["n"]
        if n < 2:
            continue
        flat = r["low"] == r["high"] or r["low2"] == r["high2"]
        sxy = 0.0 if flat else r["p"] - r["s"] * r["t"] / n
        sxx, syy = r["ss"] - r["s"] ** 2 / n, r["tt"] - r["t"] ** 2 / n
        cov[r["i"], r["j"]] = sxy / (n - 1)
        if not flat and sxx > 0 and syy > 0:
            corr[r["i"], r["j"]] = sxy / math.sqrt(sxx * syy)
    return PairMoments(columns, cov, corr)
