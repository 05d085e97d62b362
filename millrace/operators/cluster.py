"""K-means segments.

All starts go together: the rows are packed once into cached blocks of doubles, and every pass over them moves the centres
of all starts that still move. Starts are drawn as in k-means||: two rounds take rows with odds in proportion to their
squared distance from what is drawn, and the drawn rows, weighted by the rows nearest to them, are reduced to k. Draws
follow hashes of the rows' values, so files and partitions have no say in them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.base import Fitted, step
from millrace.operators.scale import NumericStep, _filled_spread, chosen, filled
from millrace.schema import dbl

BLOCK = 2048       # rows whose distances are held at once
ROUNDS, DRAWN = 2, 2   # rounds of draws, and rows that each draws, as a multiple of k
LOCAL = 30         # steps on the drawn rows
MOVED = 1e-4       # centres that move less have settled
MAX_TERMS = 256    # products written out as column arithmetic


class KMeansFitted(Fitted):
    def __init__(self, params, metadata):
        super().__init__("kmeans", params, KMeansClusters.apply, metadata)

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.params["centres"]]

    @property
    def model(self):
        return self


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the row's own square: starts x centres x rows."""
    starts, k, width = centres.shape
    terms = np.concatenate([-2 * centres, (centres ** 2).sum(axis=2)[..., None]], axis=2).reshape(starts * k, width + 1)
    return (terms @ np.concatenate([x, np.ones((len(x), 1))], axis=1).T).reshape(starts, k, len(x))


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre, of each start and row."""
    return np.maximum(_gaps(x, centres).min(axis=1) + (x ** 2).sum(axis=1), 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of rows, others for each salt."""
    z = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54


def _packed(df: DataFrame, means: dict) -> DataFrame:
    """Blocks of rows, less their means, as bytes, with hashes of the values."""
    columns = [(filled(c, m) - F.lit(float(m))).alias(f"x{i}") for i, (c, m) in enumerate(means.items())]
    rows = df.select(*columns, F.xxhash64(*[dbl(c) for c in means]).alias("h"))  # a mean's last digit hangs on the partitions

    def pack(batches):
        for pdf in batches:
            x = pdf[[c for c in pdf.columns if c != "h"]].to_numpy(dtype=float)
            for a in range(0, len(x), BLOCK):
                yield pd.DataFrame({"x": [np.ascontiguousarray(x[a:a + BLOCK]).tobytes()], "h": [pdf["h"].to_numpy("int64")[a:a + BLOCK].tobytes()]})

    return rows.mapInPandas(pack, "x binary, h binary")


def _pass(table: DataFrame, width: int, merge) -> list:
    """`merge(so far or None, rows, hashes)` over the blocks of each task; what each task ends with."""
    def run(batches):
        state = None
        for pdf in batches:
            for x, h in zip(pdf["x"], pdf["h"]):
                state = merge(state, np.frombuffer(x, np.float64).reshape(-1, width), np.frombuffer(h, np.int64))
        if state is not None:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    return [pickle.loads(r["state"]) for r in table.mapInPandas(run, "state binary").collect()]


def _least(found: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows of least key; copies of a row share their key and count once."""
    at = np.flatnonzero(keys < (found[0][n - 1] if found is not None and len(found[0]) == n else np.inf))
    keys, rows = keys[at], x[at]
    if found is not None:
        keys, rows = np.concatenate([found[0], keys]), np.concatenate([found[1], rows])
    keys, first = np.unique(keys, return_index=True)
    return keys[:n], rows[first[:n]]


def _draw(table: DataFrame, width: int, centres: np.ndarray | None, n: int, salts: list[int]) -> list[np.ndarray]:
    """For each start, n rows drawn with odds in proportion to their squared distance from its centres; all alike without."""
    def merge(state, x, h):
        far = _far(x, centres) if centres is not None else np.ones((len(salts), len(x)))
        out = []
        for s, salt in enumerate(salts):
            with np.errstate(divide="ignore"):
                keys = np.where(far[s] > 0, -np.log(_uniform(h, salt)) / far[s], np.inf)
            out.append(_least(state and state[s], keys, x, n))
        return out

    parts = _pass(table, width, merge)
    found = []
    for s in range(len(salts)):
        keys, rows = np.concatenate([p[s][0] for p in parts]), np.concatenate([p[s][1] for p in parts])
        found.append(rows[np.unique(keys, return_index=True)[1]][:n])
    return found


def _stacked(lists: list[np.ndarray]) -> np.ndarray:
    """Centres of all starts in one array; a shorter list repeats its first, which then loses every tie."""
    most = max(map(len, lists))
    return np.stack([np.concatenate([c, np.repeat(c[:1], most - len(c), axis=0)]) for c in lists])


def _sums(table: DataFrame, width: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start: rows and sums of rows by nearest centre, and the total squared distance."""
    k = centres.shape[1]

    def merge(state, x, h):
        gaps = _gaps(x, centres)
        best = gaps.min(axis=1)
        own = gaps <= best[:, None]
        if np.count_nonzero(own) > best.size:  # of centres as near as each other the first has the row
            own &= own.cumsum(axis=1) == 1
        sums = (own.reshape(-1, len(x)).astype(float) @ np.concatenate([x, np.ones((len(x), 1))], axis=1)).reshape(len(centres), k, width + 1)
        new = (sums[..., -1], sums[..., :-1], best.sum(axis=1) + (x ** 2).sum())
        return new if state is None else tuple(a + b for a, b in zip(state, new))

    parts = _pass(table, width, merge)
    return tuple(sum(p[i] for p in parts) for i in range(3))


def _reduced(rows: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the drawn rows: k-means++ and some steps."""
    centres = rows[[rng.choice(len(rows), p=weight / weight.sum())]]
    while len(centres) < k:
        odds = weight * _far(rows, centres[None])[0]
        if odds.sum() <= 0:
            break
        centres = np.concatenate([centres, rows[[rng.choice(len(rows), p=odds / odds.sum())]]])
    for _ in range(LOCAL):
        near = _gaps(rows, centres[None])[0].argmin(axis=0)
        new = np.stack([np.average(rows[near == c], axis=0, weights=weight[near == c]) if weight[near == c].sum() > 0 else centres[c]
                        for c in range(len(centres))])
        if (new == centres).all():
            break
        centres = new
    return centres


def _begun(table: DataFrame, width: int, k: int, starts: int, seed: int) -> np.ndarray:
    """Centres that each start begins with."""
    salts = [(seed + s) * (ROUNDS + 1) for s in range(starts)]
    drawn = _draw(table, width, None, 1, salts)
    for r in range(1, ROUNDS + 1):
        more = _draw(table, width, _stacked(drawn), DRAWN * k, [salt + r for salt in salts])
        drawn = [np.concatenate([a, b]) for a, b in zip(drawn, more)]
    weight = _sums(table, width, _stacked(drawn))[0]
    return _stacked([_reduced(d, weight[s, :len(d)], k, np.random.default_rng([seed, s])) for s, d in enumerate(drawn)])


@step("kmeans")
class KMeansClusters(NumericStep):
    """Adds `cluster`; the best of `n_init` starts by total squared distance."""

    @classmethod
    def extra(cls):
        return {"n_clusters": 3, "max_iter": 300, "n_init": 10, "seed": 42}

    def fit(self, df):
        columns = chosen(df, self.options, "K-Means clustering")
        means = {c: f["mean"] for c, f in _filled_spread(df, columns).items() if f["mean"] is not None}
        width, o = len(means), self.options
        if not means:
            raise ValueError("K-Means clustering needs a column with a value")
        table = _packed(df, means).persist()
        centres = _begun(table, width, o["n_clusters"], o["n_init"], o["seed"])
        moving = np.arange(len(centres))
        for _ in range(o["max_iter"]):
            n, total, _ = _sums(table, width, centres[moving])
            new = np.where(n[..., None] > 0, total / np.maximum(n, 1)[..., None], centres[moving])
            moved = ((new - centres[moving]) ** 2).sum(axis=2).max(axis=1)
            centres[moving] = new
            moving = moving[moved > MOVED ** 2]
            if not len(moving):
                break
        n, _, cost = _sums(table, width, centres)
        table.unpersist()
        best = int(np.argmin(cost))
        used = n[best] > 0
        found = centres[best][used] + np.array(list(means.values()))
        return KMeansFitted({"means": means, "centres": found.tolist()}, {
            "inertia": float(cost[best]), "cluster_distribution": dict(enumerate(n[best][used].astype(int).tolist()))})

    @staticmethod
    def apply(df, params):
        values = [filled(c, m) for c, m in params["means"].items()]
        centres = params["centres"]
        if len(centres) * len(values) > MAX_TERMS:
            shared = np.array(centres)
            middle = shared.mean(axis=0)

            @F.pandas_udf("int")
            def nearest(*xs: pd.Series) -> pd.Series:
                x = np.column_stack([v.to_numpy(dtype=float) for v in xs]) - middle
                near = [_gaps(x[a:a + BLOCK], (shared - middle)[None])[0].argmin(axis=0) for a in range(0, len(x), BLOCK)]
                return pd.Series(np.concatenate([np.zeros(0, int), *near]).astype("int32"))

            return df.withColumn("cluster", nearest(*values))
        far = F.array(*[sum(((v - x) * (v - x) for v, x in zip(values[1:], c[1:])), (values[0] - c[0]) * (values[0] - c[0]))
                        for c in centres])
        return (df.withColumn("__far", far).withColumn("cluster", (F.array_position("__far", F.array_min("__far")) - 1).cast("int"))
                .drop("__far"))
