"""What once filled the driver's memory: training there, and joining anew what was joined before."""

import os

from pyspark.sql import functions as F

from millrace.llm import knn_quality, links, simhash
from millrace.runtime import settle


def test_the_classifier_is_trained_in_a_task(spark, tmp_path, monkeypatch):
    train, seen = knn_quality.train, str(tmp_path / "pid")

    def noted(bags, labels):
        with open(seen, "a") as f:
            f.write(f"{os.getpid()}\n")
        return train(bags, labels)

    monkeypatch.setattr(knn_quality, "train", noted)
    docs = spark.createDataFrame([(i, "good words of prose " * 9 if i % 2 else "x$ #9 " * 30) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = knn_quality.fit(docs, labels)
    assert len(model.labels) and str(os.getpid()) not in open(seen).read().split()


def test_the_far_round_joins_labels_only(spark, monkeypatch):
    given = []
    monkeypatch.setattr(simhash, "components", lambda found: given.append(found.filter("a != b").count()) or links.components(found))
    # A chain of 40 one bit apart, and one fingerprint three bits from its end.
    chain = [(1 << i) - 1 for i in range(41)]
    fps = chain + [chain[-1] ^ (0b111 << 50), 0b1010101 << 40]
    got = {r["node"]: r["root"] for r in simhash.roots(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {f: 0 for f in fps[:-1]}
    assert given[0] >= 40 and given[1] < 10


def test_few_links_are_looked_up_by_broadcast_with_the_same_result(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 7 % 50) for i in range(60)], "a long, b long")
    few = {tuple(r) for r in links.components(df).collect()}
    monkeypatch.setattr(links, "FEW", 0)
    assert few == {tuple(r) for r in links.components(df).collect()}


def test_no_plan_of_simhash_holds_several_blocks_or_copies_of_a_table(spark, monkeypatch):
    """The driver plans, compiles and keeps what a plan names: plans of all blocks at once took most of its memory."""
    joins = []

    def noted(df, label="stage"):
        joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), label))
        return settle(df, label)

    for module in (simhash, links):
        monkeypatch.setattr(module, "settle", noted)
    rows = [(i, " ".join(f"w{(i // 3 * 7 + j) % 50}" for j in range(30 + i % 3))) for i in range(90)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    joins.append((found._jdf.queryExecution().optimizedPlan().toString().count("Join "), "result"))
    assert found.count() == 90
    assert max(joins)[0] <= 4, sorted(joins)[-5:]
