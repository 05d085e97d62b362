"""Isolation forest: trees on small samples, built and scored in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.base import step
from millrace.operators.quantiles import percentiles
from millrace.operators.scale import NumericStep, _filled_spread, chosen, filled
from millrace.runtime import release, settle

TREES = 100
SAMPLE = 256
# Rows dealt to a tree before it takes its SAMPLE, as a multiple of SAMPLE: so many that a tree practically never gets
# fewer than it needs.
MARGIN = 1.5
BLOCK = 16_384  # rows that walk down a tree together


def mean_path(n: float) -> float:
    """Mean depth at which a search in a random binary tree of n values ends."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as node arrays; leaves hold the depth plus the mean path of what is left."""
    tree = {"feature": [], "cut": [], "left": [], "right": [], "path": []}
    limit = math.ceil(math.log2(max(len(x), 2)))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(tree["feature"])
        for k in tree:
            tree[k].append(-1)
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            tree["feature"][at], tree["cut"][at] = -1, 0.0
            tree["path"][at] = depth + mean_path(len(rows))
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        side = rows[:, f] <= cut
        tree["feature"][at], tree["cut"][at], tree["path"][at] = f, cut, 0.0
        tree["left"][at] = add(rows[side], depth + 1)
        tree["right"][at] = add(rows[~side], depth + 1)
        return at

    add(x, 0)
    return tree


def _trees(df: DataFrame, columns: list[str], rows: int, seed: int) -> list[dict]:
    """Trees on samples of the whole table, drawn by hashes of the rows' values, so that files and partitions don't matter.

    Each copy of a row is dealt to each tree with probability `share`. How often a row with n copies is dealt is one
    binomial draw, and most rows draw 0, which a comparison decides; only the rest become (copy, tree) pairs.
    """
    share = min(1.0, SAMPLE * MARGIN / max(rows, 1))
    hashed = df.withColumn("h", F.xxhash64(*columns, F.lit(seed)))
    draw = (F.shiftrightunsigned(F.xxhash64("h", F.lit(1)), 11) + 1) / F.lit(float(1 << 53))  # in (0, 1]
    none = F.exp(F.col("n") * F.lit(TREES * math.log1p(-share))) if share < 1 else F.lit(0.0)
    counts = hashed.groupBy("h").agg(F.count("*").alias("n")).filter(draw > none)

    @F.pandas_udf("array<struct<tree:int,ord:bigint>>")
    def deal(h: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for key, copies in zip(h.to_numpy(), n.to_numpy()):
            rng = np.random.default_rng([seed, int(key) & (1 << 64) - 1])
            pairs = int(copies) * TREES
            got = pairs if share >= 1 else 0
            while not got:  # given that it is not 0
                got = int(rng.binomial(pairs, share))
            picked = rng.choice(pairs, got, replace=False)  # about TREES * SAMPLE * MARGIN over all rows
            out.append([{"tree": int(p % TREES), "ord": int(o)} for p, o in zip(picked, rng.integers(1 << 62, size=len(picked)))])
        return pd.Series(out, dtype=object)

    dealt = counts.select("h", F.explode(deal("h", "n")).alias("d")).select("h", "d.*")
    order = Window.partitionBy("tree").orderBy("ord", "h")
    taken = settle(dealt.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE).drop("nth", "ord"), "dealt")
    wanted = F.broadcast(taken.select("h").distinct())  # at most TREES * SAMPLE hashes
    values = settle(hashed.join(wanted, "h").dropDuplicates(["h"]), "drawn")
    drawn = taken.join(F.broadcast(values), "h").drop("h")

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        x = pdf[columns].to_numpy(dtype=float)
        tree = grow(x[np.lexsort(x.T[::-1])], rng)
        return pd.DataFrame({"tree": [int(key[0])], **{k: [v] for k, v in tree.items()}})

    found = drawn.groupBy("tree").applyInPandas(
        build, "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>")
    trees = [r.asDict() for r in found.orderBy("tree").collect()]
    release(taken)
    release(values)
    return trees


def complete(tree: dict, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of every node, and path of every last place, of the tree filled up to `depth`: node i has the children
    2i and 2i + 1, the root is 1, and all places under a leaf have its path."""
    feature, cut, path = np.zeros(1 << depth, np.int64), np.zeros(1 << depth), np.zeros(1 << depth)
    below = [(0, 1, 0)]
    while below:
        node, at, level = below.pop()
        if tree["feature"][node] < 0:
            wide = 1 << (depth - level)
            path[at * wide - len(path):][:wide] = tree["path"][node]
        else:
            feature[at], cut[at] = tree["feature"][node], tree["cut"][node]
            below += [(tree["left"][node], 2 * at, level + 1), (tree["right"][node], 2 * at + 1, level + 1)]
    return feature, cut, path


def score_column(columns: list[Column], trees: list[dict], sample: int) -> Column:
    """Anomaly score 2^(-mean depth / expected depth); a block of rows walks down one tree after the other, so that
    what a step touches stays in the processor's cache."""
    depth = math.ceil(math.log2(max(sample, 2)))
    filled_up = [complete(t, depth) for t in trees]
    expected = mean_path(sample) or 1.0

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        out = np.empty(len(values[0]))
        for a in range(0, len(out), BLOCK):
            block = np.stack([v.to_numpy(dtype=float)[a:a + BLOCK] for v in values])
            size = block.shape[1]
            flat, row, total = block.ravel(), np.arange(size), np.zeros(size)
            for feature, cut, path in filled_up:
                at, begins = 3 - (block[feature[1]] <= cut[1]).astype(np.int64), feature * size
                for _ in range(depth - 1):
                    at = 2 * at + 1 - (flat.take(begins.take(at) + row) <= cut.take(at))
                total += path.take(at - len(path))
            out[a:a + BLOCK] = total
        return pd.Series(np.exp2(-out / len(trees) / expected))

    return score(*columns)


@step("isolation_forest")
class IsolationForest(NumericStep):
    """Flags the share `contamination` of rows with the highest scores; removes them or not.

    Scores are computed on mean-filled values, rows are kept as they are.
    """

    @classmethod
    def extra(cls):
        return {"contamination": 0.1, "remove_outliers": True, "seed": 42}

    def learn(self, df):
        means, trees, sample, rows = self._grown(df)
        values = [filled(c, m) for c, m in means.items()]
        scores = settle(df.select(score_column(values, trees, sample).alias("score")), "scores")
        params = self._params(means, trees, sample, rows, scores, "score")
        release(scores)
        return params

    def _grown(self, df):
        columns = chosen(df, self.options, "outlier detection")
        spread = _filled_spread(df, columns)
        means = {c: f["mean"] for c, f in spread.items() if f["mean"] is not None}
        rows = next(iter(spread.values()))["rows"]
        table = df.select(*[filled(c, m).alias(f"f{i}") for i, (c, m) in enumerate(means.items())])
        return means, _trees(table, table.columns, rows, self.options["seed"]), min(SAMPLE, rows), rows

    def _params(self, means, trees, sample, rows, scores, name):
        limit = percentiles(scores, [name], [1 - self.options["contamination"]], {name: rows})[name][0]
        flagged = scores.filter(F.col(name) > limit).count()
        return {"means": means, "trees": trees, "sample": sample, "limit": limit,
                "remove": self.options["remove_outliers"], "rows": rows, "flagged": flagged}

    def fit_transform(self, df):
        """As fit and transform, but every row is scored once: rows are settled with their scores, which then decide."""
        if not self.options["remove_outliers"]:
            return df
        means, trees, sample, rows = self._grown(df)
        values = [filled(c, m) for c, m in means.items()]
        scored = settle(df.withColumn("__score", score_column(values, trees, sample)), "scored")
        params = self._params(means, trees, sample, rows, scored, "__score")
        return scored.filter(F.col("__score") <= params["limit"]).drop("__score")

    @staticmethod
    def scored(df: DataFrame, params: dict) -> DataFrame:
        """Adds `anomaly_score` and `is_outlier`."""
        values = [filled(c, m) for c, m in params["means"].items()]
        return (df.withColumn("anomaly_score", score_column(values, params["trees"], params["sample"]))
                .withColumn("is_outlier", F.col("anomaly_score") > params["limit"]))

    @classmethod
    def project(cls, df, params):
        if not params["remove"]:
            return df
        return cls.scored(df, params).filter(~F.col("is_outlier")).drop("anomaly_score", "is_outlier")

    apply = staticmethod(lambda df, params: IsolationForest.project(df, params))

    def describe(self, params):
        return {"outliers_detected": params["flagged"], "original_rows": params["rows"],
                "remaining_rows": params["rows"] - (params["flagged"] if params["remove"] else 0)}
