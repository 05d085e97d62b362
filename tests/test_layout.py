"""Results must not depend on partitions, caps or paths for size."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.base import restore
from millrace.operators import encode, lookup, profile as P
from millrace.operators.clean import dedupe
from millrace.operators.encode import Frequency, OneHot, Ordinal
from millrace.operators.forest import IsolationForest
from millrace.operators.moments import pair_moments
from millrace.operators.scale import Standardize
from millrace.operators.select import VarianceThreshold
from millrace.operators.text import NGramCounts, TfIdf, Word2VecDocuments, ngrams_long, tfidf_long
from millrace.functions.casts import to_moment
from millrace.sources.readers import read_table
from millrace.sources.writers import write_table


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, f"v{i * 7919 % 500:03d}" if i % 9 else None, "hot" if i % 3 else f"c{i % 11}") for i in range(2000)]
    return spark.createDataFrame(rows, "id long, many string, few string")


@pytest.mark.parametrize("small", [True, False])
def test_encoders_on_any_layout_and_size(spark, mixed, monkeypatch, small):
    if not small:
        monkeypatch.setattr(encode, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lookup, "HOT_SHARE", 10)
    values = sorted({r["many"] for r in mixed.collect() if r["many"]})
    for parts in (1, 7):
        fitted = Ordinal(columns=["many", "few"]).fit(mixed.repartition(parts))
        again = restore(json.loads(json.dumps(fitted.to_dict())))
        got = {r["id"]: (r["many"], r["few"]) for r in again.transform(mixed).collect()}
        for r in mixed.collect():
            assert got[r["id"]][0] == (None if r["many"] is None else float(values.index(r["many"])))
        new = spark.createDataFrame([(1, "unseen", "hot")], "id long, many string, few string")
        assert fitted.transform(new).first()["many"] == -1.0
        shares = restore(json.loads(json.dumps(Frequency(columns=["many", "few"]).fit(mixed.repartition(parts)).to_dict())))
        some = {r["id"]: (r["many"], r["few"]) for r in shares.transform(mixed).collect()}
        assert some[0] == (pytest.approx(mixed.filter("many is null").count() / 2000), pytest.approx(mixed.filter("few = 'c0'").count() / 2000))
        assert shares.transform(new).first()["many"] == 0.0
    one_hot = OneHot(columns=["few"])
    with pytest.raises(ValueError, match="one_hot_long"):
        encode.categories(mixed, ["many"], 10, False)
    assert one_hot.fit(mixed).transform(mixed).count() == 2000


def test_constants_have_no_spread(spark):
    df = spark.range(100_003).repartition(7).select(F.lit(1e6 + 0.3).alias("a"), F.lit(0.7 * 3).alias("b"), F.col("id").cast("double").alias("x"),
                                                    F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("gaps"))
    assert Standardize(columns=["a", "b"]).fit(df).transform(df).filter("a != 0 or b != 0").count() == 0
    assert VarianceThreshold().fit(df.drop("gaps")).metadata["selected_features"] == ["x"]
    moments = pair_moments(df, ["a", "b", "x", "gaps"])
    assert all(moments.correlation("a", c) is None and moments.correlation("b", c) is None for c in ("a", "b", "x", "gaps"))
    assert moments.correlation("x", "gaps") == pytest.approx(1.0)
    facts = P.base_facts(df)
    assert facts["a"]["std"] == 0 and facts["a"]["mean"] == 1e6 + 0.3 and P.scale_spread(facts) < 2.0
    # Constant over the complete pairs only.
    part = spark.createDataFrame([(1.3, 1.0), (1.3, 2.0), (5.0, None)], "u double, v double")
    assert pair_moments(part, ["u", "v"]).correlation("u", "v") is None


def test_forest_is_the_same_on_any_layout(spark):
    rows = [(i, float(i * 37 % 101), float(i * 53 % 89)) for i in range(3000)] + [(9000 + i, 5.0, 5.0) for i in range(1500)] + [(-1, 1e6, -1e6)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    flags = []
    for parts in (1, 7):
        fitted = IsolationForest(columns=["x", "y"], contamination=0.05).fit(df.repartition(parts))
        flags.append({r["id"] for r in IsolationForest.scored(df, fitted.params).filter("is_outlier").collect()})
        kept = IsolationForest(columns=["x", "y"], contamination=0.05).fit_transform(df.repartition(parts))
        assert {r["id"] for r in kept.collect()} == {r[0] for r in rows} - flags[-1]
    assert flags[0] == flags[1] and -1 in flags[0] and len(flags[0]) <= 0.05 * len(rows)


def test_csv_keeps_texts(spark, tmp_path):
    rows = [(1, 'say "hi", \nthen go'), (2, ""), (3, None), (4, " padded "), (5, '{"k": "v\\\\"}'), (6, "line\r\nend"), (7, "é,中")]
    df = spark.createDataFrame(rows, "id long, text string")
    write_table(df, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "t.csv"), schema="id long, text string").collect())) == rows


def test_moments_in_text(spark):
    texts = ["2024-01-02T03:04:05.123Z", "2024-01-02 03:04", "02 Jan 2024", "2024-01-02 03:04:05.5", "January 2, 2024", "2024/01/02", "01/02/2024",
             "2024-01-02T03:04:05+01:00", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["m"] for r in df.select(to_moment(F.col("t")).alias("m")).collect()]
    assert [str(m) for m in got] == ["2024-01-02 03:04:05.123000", "2024-01-02 03:04:00", "2024-01-02 00:00:00", "2024-01-02 03:04:05.500000",
                                     "2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00", "2024-01-02 02:04:05", "None"]


def test_copies_of_rows_with_maps(spark):
    df = spark.sql("select explode(array(1, 1, 2)) as a, map('k', 1, 'l', 2) as m")
    assert dedupe(df).count() == 2 and dedupe(df, keep=False).count() == 1


def test_term_forms_agree(spark):
    rows = [(1, "red fish blue fish"), (2, "Blue sky"), (3, None), (4, "!!!"), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    for step, long_form, value in ((TfIdf, tfidf_long, "value"), (NGramCounts, ngrams_long, "n")):
        fitted = step(text_column="text", max_features=6).fit(df)
        arrays = fitted.transform(df)
        assert arrays.columns == [*df.columns, fitted.params["output"]]
        pairs = {(r["id"], e["term"]): e[value if value in e.asDict() else "value"] for r in arrays.collect() for e in r[fitted.params["output"]]}
        got = {(r["id"], r["term"]): r[value] for r in long_form(df, ["id"], fitted).collect()}
        assert pairs == pytest.approx(got)
        wide = step.wide_form(arrays, sorted({t for _, t in got}), fitted.params["output"]).collect()
        assert {(r["id"], t): v for r in wide for t, v in r.asDict().items() if t not in ("id", "text") and v} == pytest.approx(got)


def test_word_vectors_on_any_layout(spark):
    rows = [(i, " ".join(["red", "fish", "blue", "sky"][(i + k) % 4] for k in range(6))) for i in range(40)] + [(99, "alone"), (100, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    step = Word2VecDocuments(text_column="text", key=["id"], vector_size=4, partitions=1)
    a, b = ({r["id"]: r["w2v"] for r in step.fit(df.repartition(k)).transform(df).collect()} for k in (1, 5))
    assert a[99] == a[100] == [0.0] * 4 and any(a[0])
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)


def test_copies_are_counted_exactly(spark, monkeypatch):
    rows = [(i % 50, None if i % 3 else "x", float(i % 2) * -0.0) for i in range(400)] + [(None, "a", 0.0), ("a" and None, "a", -0.0)]
    df = spark.createDataFrame(rows, "a long, b string, c double").repartition(5)
    plain = len(rows) - len(set(rows))
    assert P.copy_tally(df) == (len(rows), plain)
    assert P.duplicate_count(df, ["b"]) == len(rows) - 3
    # Where the hashes of different rows meet, the rows themselves decide.
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert P.copy_tally(df) == (len(rows), plain)
    assert P.copy_tally(df.limit(0)) == (0, 0)
