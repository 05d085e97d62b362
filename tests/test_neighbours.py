import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import knn


def frame(spark, x, names):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in names))


def plain_fill(x, k):
    """Each gap by the mean of the k nearest rows that have the value; ties to the smaller value, the column's mean without any."""
    out, width = x.copy(), x.shape[1]
    for i, t in zip(*np.nonzero(np.isnan(x))):
        near = []
        for row in x:
            shared = ~np.isnan(x[i]) & ~np.isnan(row)
            if not np.isnan(row[t]) and shared.any():
                near.append((sum((x[i][f] - row[f]) ** 2 for f in np.flatnonzero(shared)) * (width / shared.sum()), row[t]))
        near = sorted(near)[:k]
        out[i, t] = np.mean([v for _, v in near]) if near else np.nanmean(x[:, t])
    return out


@pytest.mark.parametrize("gaps", [0.05, 0.4])
def test_imputation_over_many_sets_of_missing_features(spark, monkeypatch, gaps):
    monkeypatch.setattr(knn, "CELL", 12)
    monkeypatch.setattr(knn, "CHUNK", 8)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 4)) + rng.integers(0, 4, (160, 1)) * 9, 2)
    x[rng.random(x.shape) < gaps] = np.nan
    x[:20] = x[40]          # copies
    x[21] = np.nan          # a row without any feature
    df = frame(spark, x, "abcd").withColumn("vec", F.lit("v"))
    want = plain_fill(x, 3)
    model = knn.KnnImpute(n_neighbors=3, columns=list("abcd")).fit(df)
    got = {r["id"]: [r[c] for c in "abcd"] for r in model.transform(df.withColumnRenamed("vec", "other")).collect()}
    assert len(got) == len(x)
    for i, row in enumerate(want):
        assert got[i] == pytest.approx(list(row), abs=1e-9)


def test_few_blocks_are_met_on_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 50)
    monkeypatch.setattr(knn, "CHUNK", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6)) + rng.integers(0, 12, 3000)[:, None] * 15 + rng.integers(0, 5, (3000, 1)) * 4
    vecs = spark.createDataFrame([(row.tolist(), i) for i, row in enumerate(x)], "vec array<double>, tag long")
    tally: dict = {}
    found, queries = knn.search(vecs.withColumn("n", F.lit(1)), vecs.select("vec"), 4, 6, tally=tally)
    near = {}
    names = {tuple(row.tolist()): i for i, row in enumerate(x)}
    for r in found.join(queries, "qid").collect():
        near.setdefault(names[tuple(r["vec"])], []).append((r["rank"], r["tag"]))
    for i in random.Random(1).sample(range(3000), 200):
        assert [t for _, t in sorted(near[i])] == np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:4].tolist()
    assert tally["met"] < 0.2 * tally["all"]


def test_bounds_are_never_above_the_distance():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5))
    x[:100][rng.random((100, 5)) < 0.3] = np.nan
    import pandas as pd
    rows = []
    for b in range(10):
        part = x[b * 20:b * 20 + 20]
        here = ~np.isnan(part)
        mean = np.where(here, part, 0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
        rows.append({"block": b, "size": 20, "radius": np.sqrt((np.where(here, part - mean, 0) ** 2).sum(axis=1).max()),
                     "low": np.where(here, part, np.inf).min(axis=0), "high": np.where(here, part, -np.inf).max(axis=0), "mean": mean,
                     "full": here.all(axis=0), "any": here.any(axis=0), "held": here.sum(axis=0)})
    listed = pd.DataFrame([{k: v.astype(float).tobytes() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows])
    index = knn.Blocks(listed, 5)
    for lacks in ((), (0,), (1, 3)):
        q = rng.normal(size=(30, 5)) * 2
        q[:, list(lacks)] = np.nan
        true = knn._distances(q, x).reshape(30, 10, 20).min(axis=2)
        assert (index.bounds(q) <= true).all()


@pytest.mark.parametrize("scale, offset, gaps", [(1, 0, 0), (1, 1e9, 0), (1e-25, 0, 0), (1e25, 0, 0), (1, 3, 0.3)])
def test_products_rule_out_no_pair_in_reach(scale, offset, gaps):
    rng = np.random.default_rng(6)
    x, q = (rng.integers(-9, 9, (n, 6)).astype(float) * scale + offset for n in (300, 40))
    for part in (x, q):
        part[rng.random(part.shape) < gaps] = np.nan
    dist = knn._distances(q, x)
    limit = np.sort(dist, axis=1)[:, 7]
    i, j, got = knn._passing(q, knn._Donors(x), limit)
    want = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    assert (i == want[0]).all() and (j == want[1]).all() and (got == dist[want]).all()


def test_a_group_gives_only_its_k_nearest(spark, monkeypatch):
    """Blocks stream past a group of queries: no candidates of each block are left for a later step, and queries aren't sent to each block."""
    monkeypatch.setattr(knn, "CELL", 50)
    x = np.random.default_rng(7).normal(size=(700, 16))
    vecs = spark.createDataFrame([(row.tolist(), i) for i, row in enumerate(x)], "vec array<double>, tag long")
    sent, real = [], knn._streamed
    monkeypatch.setattr(knn, "_streamed", lambda chunks, visits, *a: sent.append((visits.columns, knn.settle(real(chunks, visits, *a)))) or sent[0][1])
    found, queries = knn.search(vecs.withColumn("n", F.lit(1)), vecs.select("vec"), 5, 16)
    assert sent[0][0] == ["grp", "chunk", "block", "ord"] and sent[0][1].count() == 700 * 5
    near = {tuple(r["vec"]): r["t"] for r in found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("n"))
            .select("qid", F.col("n.tag").alias("t")).join(queries, "qid").collect()}
    for i in range(700):
        assert near[tuple(x[i].tolist())] == np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:5].tolist()
