import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.base import restore
from millrace.operators import cluster


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double").repartition(parts)


def total(x, centres):
    return ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1).sum()


def plain(x, centres):
    for _ in range(300):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return total(x, centres)


def test_all_starts_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2)) * [3, 900] + [5, 1e5]
    passes, real = [], cluster._pass
    monkeypatch.setattr(cluster, "_pass", lambda *a: passes.append(1) or real(*a))
    fitted = cluster.KMeansClusters(columns=["a", "b"], n_clusters=4).fit(table(spark, x))
    # Ten starts one after the other would take several times as many.
    assert len(passes) <= 5 + 300
    best = min(plain(x, x[rng.choice(len(x), 4, replace=False)]) for _ in range(10))
    assert fitted.metadata["inertia"] == pytest.approx(total(x, fitted.params["centres"]), rel=1e-9)
    assert fitted.metadata["inertia"] <= best * 1.0001
    got = {r["id"]: r["cluster"] for r in fitted.transform(table(spark, x)).collect()}
    near = ((x[:, None] - np.array(fitted.params["centres"])[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[i] for i in range(len(x))] == near.tolist()
    assert fitted.metadata["cluster_distribution"] == dict(enumerate(np.bincount(near, minlength=4).tolist()))


def test_files_have_no_say_and_missing_values_take_the_mean(spark):
    x = np.random.default_rng(1).normal(size=(400, 2))
    df = table(spark, x).withColumn("b", F.expr("case when id % 7 = 0 then null else b end"))
    a, b = (cluster.KMeansClusters(columns=["a", "b"]).fit(df.repartition(k)) for k in (1, 6))
    assert np.allclose(a.params["centres"], b.params["centres"])
    assert restore(a.to_dict()).transform(df).exceptAll(a.transform(df)).isEmpty()


@pytest.mark.parametrize("rows, found", [([(1, 1)] * 5, 1), ([(0, 0)] * 4 + [(2, 2)] * 3, 2), ([(0, 0), (1, 0), (3, 0)], 3)])
def test_fewer_vectors_than_clusters(spark, rows, found):
    fitted = cluster.KMeansClusters(columns=["a", "b"]).fit(table(spark, rows, 1))
    assert len(fitted.params["centres"]) == found
    assert fitted.metadata["inertia"] == pytest.approx(0, abs=1e-9)
    assert sum(fitted.metadata["cluster_distribution"].values()) == len(rows)


def test_many_columns_take_the_matrix_path(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(200, 2)) * 5
    fitted = cluster.KMeansClusters(columns=["a", "b"]).fit(table(spark, x))
    want = {r["id"]: r["cluster"] for r in fitted.transform(table(spark, x)).collect()}
    monkeypatch.setattr(cluster, "MAX_TERMS", 1)
    assert {r["id"]: r["cluster"] for r in fitted.transform(table(spark, x)).collect()} == want
