"""Counting the sides of few points gives what grouping by slots gives, without a row per value."""

import random

import pytest

from millrace.operators import quantiles as Q


@pytest.mark.parametrize("few", [0, 20])
def test_both_ways_of_narrowing_are_exact(spark, monkeypatch, few):
    rng = random.Random(5)
    rows = [(rng.choice([1.0, 2.0, rng.random() * 9]), None if i % 5 == 0 else float(i % 7), -0.0 if i % 2 else 0.0, float("inf") if i == 3 else -i / 3.0)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    monkeypatch.setattr(Q, "FEW_POINTS", few)
    monkeypatch.setattr(Q, "COLLECT_VALUES", 50)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    assert Q.percentiles(df, ["a", "b", "c", "d"], probs, small_cells=0) == Q.percentiles(df, ["a", "b", "c", "d"], probs, small_cells=10**9)


def test_few_points_make_no_row_per_value(spark, monkeypatch):
    monkeypatch.setattr(Q, "COLLECT_VALUES", 50)
    monkeypatch.setattr(Q, "_grouped", None)
    df = spark.range(5000).selectExpr("cast(id as double) as x", "cast(id * 7 % 5000 as double) as y")
    assert Q.percentiles(df, ["x", "y"], [0.5], small_cells=0) == {"x": [2499.5], "y": [2499.5]}
