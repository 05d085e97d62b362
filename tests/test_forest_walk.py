"""The walk over filled-up trees ends in the leaves that a plain walk finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import forest


def plain(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left" if row[tree["feature"][at]] <= tree["cut"][at] else "right"][at]
    return tree["path"][at]


@pytest.mark.parametrize("sample", [1, 2, 3, 60, 256])
def test_filled_up_trees_score_as_plain_ones(spark, sample):
    rng = np.random.default_rng(sample)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 4, 3000), np.zeros(3000), rng.exponential(size=3000)])
    trees = [forest.grow(x[rng.integers(0, len(x), sample)], rng) for _ in range(9)]
    # Values that equal a cut go left.
    cuts = [(t["feature"][i], t["cut"][i]) for t in trees for i in range(len(t["cut"])) if t["feature"][i] >= 0][:50]
    for i, (f, c) in enumerate(cuts):
        x[i, f] = c
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    got = df.select("id", forest.score_column([F.col(c) for c in "abcd"], trees, sample).alias("s")).collect()
    base = forest.mean_path(sample) or 1.0
    for r in got:
        assert r["s"] == pytest.approx(2 ** (-sum(plain(t, x[r["id"]]) for t in trees) / len(trees) / base), rel=1e-12)


def test_a_walk_holds_one_number_a_row_not_one_a_tree():
    tree = forest.grow(np.random.default_rng(0).normal(size=(256, 3)), np.random.default_rng(1))
    feature, cut, path = forest.complete(tree, 8)
    assert len(feature) == len(cut) == len(path) == 256 and (path > 0).all()
