import pytest
from pyspark.sql import functions as F

from millrace.operators import knn, profile as P, quantiles as Q
from millrace.operators.clean import FixTypes
from millrace.operators.scale import MinMax, Standardize
from millrace.sources.catalog import without_secrets
from millrace.sources.readers import database_options, read_table


def test_narrowing_finds_exact_percentiles(spark, monkeypatch):
    # A third of the rows share one value.
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 7.0D else (id * 7919 % 3001) / 10.0D end as x")
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    want = Q.percentiles(df, ["x"], probs)["x"]
    monkeypatch.setattr(Q, "SMALL_CELLS", 0)
    monkeypatch.setattr(Q, "COLLECT_VALUES", 20)
    monkeypatch.setattr(Q, "ACCURACY", 50)
    assert Q.percentiles(df, ["x"], probs)["x"] == pytest.approx(want)


def test_constant_columns_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, c double")
    assert [r["c"] for r in Standardize().fit_transform(df).collect()] == [0.0, 0.0]
    assert [r["c"] for r in MinMax(low=2.0, high=3.0).fit_transform(df).collect()] == [2.0, 2.0]
    assert P.correlated_pairs(df).count() == 0


def test_skew_and_pairwise_covariance(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert P.base_facts(x)["x"]["skew"] == pytest.approx(2.0287, abs=1e-4)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 3.0), (3.0, 7.0), (4.0, 6.0)], "a double, b double")
    moments = P.pair_moments(pairs, ["a", "b"])
    assert moments.covariance("a", "b") == pytest.approx(3.5)
    assert moments.correlation("a", "b") == pytest.approx(0.866025, abs=1e-6)


def test_neighbours_are_exact_over_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 16)
    rows = [(i, float(i * 37 % 101), float(i * 53 % 89) if i % 4 else 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {}
    for r in knn.knn_edges(df, "id", 3).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i, a, b in rows:
        near = sorted((((a - x) ** 2 + (b - y) ** 2), j) for j, x, y in rows if j != i)[:3]
        assert [d for _, d in sorted(got[i])] == [j for _, j in near]


def test_type_repair_needs_ninety_percent(spark):
    rows = [(str(i), str(i) if i % 20 < 17 else "x") for i in range(19)] + [("x", "x")]
    kinds = FixTypes().fit(spark.createDataFrame(rows, "a string, b string")).params["kinds"]
    assert kinds == {"a": "number"}


def test_sources(spark, tmp_path):
    assert without_secrets({"host": "h", "DB_Password": "p", "apikey": 1, "token_id": 2}) == {"host": "h", "apikey": "1"}
    with pytest.raises(ValueError):
        database_options("mysql")
    split = database_options("postgresql", query="select 1", host="h", database="d", partition_column="id",
                             lower_bound=0, upper_bound=9, num_partitions=3)
    assert split["url"] == "jdbc:postgresql://h:5432/d" and split["dbtable"] == "(select 1) q"
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_table(spark, str(tmp_path / "a.json")).agg(F.sum("a")).first()[0] == 3
    with pytest.raises(ValueError):
        read_table(spark, "x.xlsx")
