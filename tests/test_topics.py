import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import text as X
from millrace.operators import topics as T


def test_gamma_functions():
    x = np.array([1e-3, 0.2, 1.0, 3.7, 50.0, 1e5])
    h = 1e-5 * x
    slope = [(math.lgamma(a + d) - math.lgamma(a - d)) / (2 * d) for a, d in zip(x, h)]
    assert np.allclose(T.digamma(x), slope, rtol=1e-6)
    assert np.allclose(T.trigamma(x), (T.digamma(x + h) - T.digamma(x - h)) / (2 * h), rtol=1e-4)


def test_bags_settle_where_plain_steps_do():
    rng = np.random.default_rng(5)
    beta, alpha = np.exp(T.expected_log(rng.gamma(2.0, 1.0, (3, 40)).T)).T, np.array([0.3, 0.5, 0.2])
    texts = [[f"t{w}" for w in rng.integers(0, 45, size)] for size in (0, 1, 30, 400, 0, 7)]
    rows, terms, counts = T.bags(pa.array(texts, pa.list_(pa.string())), pa.array([f"t{i}" for i in range(40)]))
    gamma = T.settle_bags(T.starts_of(rows), terms, counts, beta, alpha)
    assert counts.sum() == sum(int(w[1:]) < 40 for t in texts for w in t)
    for at, row in enumerate(sorted(set(rows))):
        own = rows == row
        g = np.ones(3)
        for _ in range(5000):
            theta = np.exp(T.expected_log(g))
            g = alpha + theta * (beta[:, terms[own]] @ (counts[own] / (theta @ beta[:, terms[own]])))
        assert np.abs(gamma[:, at] - g).max() < 0.05, (row, gamma[:, at], g)


def test_a_round_reads_every_word_once(spark):
    """The bags of any layout give the same sums, which add up to the words there are."""
    rows = [(i, " ".join(["sun", "moon"] * (i % 4) + ["rock"] * (i % 3))) for i in range(60)]
    words, vocabulary = F.split("t", " "), ["moon", "rock", "sun"]
    total = sum(t.split(" ").count(w) for _, t in rows for w in vocabulary)
    beta, alpha, found = np.array([[0.5, 0.2, 0.3], [0.1, 0.6, 0.3]]), np.full(2, 0.5), []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "id long, t string").repartition(parts)
        table, stats, logs, n = T._round(T._packed(df, words, vocabulary), beta, alpha)
        assert n == sum(t != "" for _, t in rows) and math.isclose((stats * beta).sum(), total)
        again, stats2, _, n2 = T._round(table, beta, alpha)  # from where they settled
        assert n2 == n and math.isclose((stats2 * beta).sum(), total)
        found.append((stats, logs))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1])


def test_topics_part_two_subjects(spark):
    words = {0: "river lake water fish boat".split(), 1: "stone hill rock cliff sand".split()}
    rng = np.random.default_rng(0)
    rows = [(i, "The " + " ".join(rng.choice(words[i % 2], 40))) for i in range(80)] + [(80, None), (81, ""), (82, "zz unknown")]
    df = spark.createDataFrame(rows, "id long, text string")
    model = X.TopicModel(text_column="text", n_topics=2, max_features=10, max_iter=10).fit(df)
    got = {r["id"]: r for r in model.transform(df).collect()}
    assert len(got) == 83 and all(abs(r["topic_1"] + r["topic_2"] - 1) < 1e-9 for r in got.values())
    assert all(got[i]["topic_1"] == 0.5 for i in (80, 81, 82))
    assert "the" not in model.vocabulary and len(model.metadata["top_words"]["topic_1"]) == 10
    mains = [{got[i]["dominant_topic"] for i in range(s, 80, 2)} for s in (0, 1)]
    assert all(len(m) == 1 for m in mains) and mains[0] != mains[1]


def test_slices_settle_as_the_whole_does(monkeypatch):
    rng = np.random.default_rng(8)
    beta, alpha = np.exp(T.expected_log(rng.gamma(2.0, 1.0, (3, 40)).T)).T, np.array([0.3, 0.5, 0.2])
    texts = [[f"t{w}" for w in rng.integers(0, 40, size)] for size in (9, 1, 30, 400, 0, 7, 80)]
    rows, terms, counts = T.bags(pa.array(texts, pa.list_(pa.string())), pa.array([f"t{i}" for i in range(40)]))
    starts = T.starts_of(rows)
    whole = T.settle_bags(starts, terms, counts, beta, alpha)
    monkeypatch.setattr(T, "PAIRS", 30)
    sizes = []
    for own, pairs, _, gamma in T.in_slices(starts, terms, counts, beta, alpha):
        assert np.allclose(gamma, whole[:, own])
        sizes.append((own.stop - own.start, pairs.stop - pairs.start))
    assert sum(n for n, _ in sizes) == 6 and all(n == 1 or size <= 30 for n, size in sizes) and len(sizes) > 2


def test_no_row_of_bags_holds_many_texts(spark):
    """A reader takes thousands of rows at once, whatever a row holds."""
    df = spark.range(900).selectExpr("id", "concat('sun moon rock ', id) as t").coalesce(1)
    table = T._packed(df, F.split("t", " "), ["moon", "rock", "sun"])
    assert table.count() == 900
    again = T._round(table, np.full((2, 3), 0.3), np.full(2, 0.5))[0]
    assert again.count() == 900 and max(len(r["terms"]) + len(r["counts"]) + len(r["gamma"]) for r in again.collect()) < 100
