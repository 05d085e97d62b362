"""Sides that grow behind an explode are not broadcast, however small Spark takes them for."""

from pyspark.sql import functions as F

from millrace.llm import line_dedup, ngram_join, simhash
from millrace.runtime import settle


def watched(monkeypatch, *modules):
    """Gathers label -> planned broadcasts of what is settled from now on."""
    plans: dict[str, int] = {}

    def noted(df, label="stage"):
        plans[label] = plans.get(label, 0) + df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
        return settle(df, label)

    for module in modules:
        monkeypatch.setattr(module, "settle", noted)
    return plans


def test_simhash_broadcasts_no_balls_and_no_points(spark, monkeypatch):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB")
    plans = watched(monkeypatch, simhash)
    fps = [0, 1, 3, 0b111 << 30, (0b111 << 30) | 1, 0b1010101 << 40, 1 | (0b11 << 50)]
    got = {r["node"]: r["root"] for r in simhash.roots(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert set(got.values()) == {0} and set(got) == set(fps) - {0b1010101 << 40}
    assert {"near", "members", "points"} <= set(plans)
    assert not any(plans[x] for x in ("near", "members", "points")), plans


def test_many_components_of_the_far_round_are_not_broadcast(spark, monkeypatch):
    fps = spark.createDataFrame([(i << 8 | x,) for i in (0, 0b1111 << 20, 0b11111 << 40) for x in (0, 0b111)], "fp long")
    few = {tuple(r) for r in simhash.roots(fps).collect()}
    monkeypatch.setattr(simhash, "FEW", 0)
    assert {tuple(r) for r in simhash.roots(fps).collect()} == few and len(few) == 6


def test_the_map_of_wanted_texts_passes_all_of_them_and_few_others(spark):
    for n in (0, 1, 17, 30_000):
        wanted = spark.range(n).select(F.xxhash64("id").alias("t"))
        bits = ngram_join.bit_map(wanted)
        assert 8 * len(bits) <= 16 * max(n, 1)
        found = spark.range(2 * n + 100).select("id", F.xxhash64("id").alias("t")).filter(ngram_join.in_map(spark, "t", bits))
        ids = {r["id"] for r in found.collect()}
        assert ids >= set(range(n)) and len(ids) - n <= 0.2 * (n + 100)


def test_ngram_join_broadcasts_no_table_that_grows_with_the_documents(spark, monkeypatch):
    plans = watched(monkeypatch, ngram_join)
    rows = [(i, " ".join(f"w{i // 3}_{j}" for j in range(60 - i % 3))) for i in range(30)]
    found = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i // 3 * 3) for i in range(30)}
    assert {"members", "pairs", "wanted", "sets"} <= set(plans)
    assert not any(plans[x] for x in ("members", "pairs", "wanted", "sets")), plans


def test_line_dedup_broadcasts_no_keys(spark, monkeypatch):
    plans = watched(monkeypatch, line_dedup)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, f"this line of text is alone {'x' * i}\nthis line stands {'twice' if i else 'twine'} or so") for i in range(3)]
    found = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in found.collect()] == [(0, rows[0][1])]
    assert {"chosen", "lines"} <= set(plans) and not plans["chosen"] and not plans["lines"], plans
