import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import hilbert, line_dedup, oracles, packing, quality_rules, queries, simhash, url_filter
from tests.llm.test_documents import one_edit


def asks():
    return F.col("vec_id") % 20 == 0


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_curves_visit_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in good:
        if q % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def answers(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_with_copies_ties_and_broken_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("f4").astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0] + [0.0] * 7) for i in range(300, 420)]  # one vector many times, also among the queries
    rows += [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] + [1.0] * 7),
             (580, [float("inf")] + [1.0] * 7), (600, []), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as vid", "'w' as window").repartition(6)
    got = hilbert.search(df, asks(), k=20)
    assert answers(got) == brute(rows, 20)
    known = dict((i, v) for i, v in rows[:420])
    for r in got.collect():
        assert r["score"] == pytest.approx(float(np.dot(known[r["query_id"]], known[r["vec_id"]])), abs=1e-12)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (40, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(hilbert.search(df, asks(), k=20)) == brute(rows, 20)
    assert hilbert.search(df.limit(0), asks()).count() == 0
    assert hilbert.search(df.filter("vec_id = 1"), asks()).count() == 0
    assert hilbert.search(df.filter("vec_id = 0"), asks()).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_with_many_windows(spark, monkeypatch, clustered):
    """Recall against brute force holds on vectors without structure; structure needs no more than neighbouring windows."""
    monkeypatch.setattr(hilbert, "WINDOW", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    x = rng.normal(size=(2000, 16)) * (0.3 if clustered else 1) + (centres[rng.integers(40, size=2000)] if clustered else 0)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, want = answers(hilbert.search(df, asks(), k=20)), brute(rows, 20)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


DAY = dt.date(2024, 5, 1)


def test_urls_are_judged_at_fetch_time(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    log = [("bad.org", "add", d(0)), ("bad.org", "remove", d(10)), ("bad.org", "add", d(20)), ("shop.net/sale", "add", d(5)),
           ("*.Wild.com", "add", d(0)), ("tie.org", "add", d(3)), ("tie.org", "remove", d(3)), ("bad.org", "add", d(0)),
           (None, "add", d(0)), ("x.org", None, d(0)), ("x.org", "add", None), ("never.org", "remove", d(1))]
    pages = [(1, "http://bad.org/a", d(0)), (2, "http://www.bad.org/a", d(9)), (3, "https://BAD.org:80", d(10)), (4, "http://bad.org", d(25)),
             (5, "http://notbad.org/", d(5)), (6, "http://shop.net/sale/1?x", d(6)), (7, "http://shop.net/sales", d(6)),
             (8, "http://u:p@a.b.wild.com./x", d(1)), (9, "http://tie.org", d(4)), (10, None, d(1)), (11, "nonsense", d(1)),
             (12, "http://bad.org", None), (None, "http://bad.org/", d(1)), (1, "http://bad.org/a", d(0)), (13, "", d(1)),
             (14, "http://" + "a." * 3000 + "bad.org/" + "s/" * 3000, d(1)), (15, "//x.org/", d(1)), (16, "http://never.org", d(2))]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date").selectExpr("*", "'h' as host", "1 as key")
    entries = spark.createDataFrame(log, "rule string, action string, at date")
    got = url_filter.judge(captures, entries).collect()
    blocked = sorted((str(r["page_id"]), r["rule"], str(r["since"])) for r in got if r["blocked"])
    assert blocked == sorted([("1", "bad.org", str(d(0))), ("1", "bad.org", str(d(0))), ("2", "bad.org", str(d(0))), ("4", "bad.org", str(d(20))),
                              ("6", "shop.net/sale", str(d(5))), ("8", "wild.com", str(d(0))), ("9", "tie.org", str(d(3))),
                              ("None", "bad.org", str(d(0))), ("14", "bad.org", str(d(0)))])
    assert len(got) == len(pages)
    assert not any(r["blocked"] for r in url_filter.judge(captures, entries.limit(0)).collect())
    assert url_filter.judge(captures.limit(0), entries).count() == 0


def test_path_rules_keep_their_case(spark):
    log = [("Shop.NET/Sale", "add", DAY), ("*.Wild.com/A/b/", "add", DAY), ("PLAIN.org", "add", DAY)]
    pages = [(1, "http://shop.net/Sale/1", DAY), (2, "http://SHOP.net/Sale", DAY), (3, "http://shop.net/sale/1", DAY),
             (4, "http://wild.com/A/b", DAY), (5, "http://wild.com/a/b", DAY), (6, "http://plain.org/Any", DAY)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, fetched date"),
                           spark.createDataFrame(log, "rule string, action string, at date")).collect()
    assert {r["page_id"]: r["rule"] for r in got if r["blocked"]} == {
        1: "shop.net/Sale", 2: "shop.net/Sale", 4: "wild.com/A/b", 6: "plain.org"}


def test_native_plans_hold_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op3_url_filter", "op7_license_scan"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_url_filter", "op6_line_dedup", "op7_license_scan"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = db.execute(oracles_of(name)).fetchall()
    columns = [c[0] for c in db.description]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def oracles_of(name):
    assert queries.ORACLES[name] in vars(oracles).values()
    return queries.ORACLES[name]


def test_pipeline_stages(spark):
    """Each stage against what its operator promises, over a small table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "simhash_near_dedup",
                                                      "best_fit_packing"]
    rows = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        rows = stage(spark, rows, sf).cache()
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert rows.columns == docs.columns
        after = {r["doc_id"]: r for r in rows.collect()}
        assert set(after) <= set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "quality_rules":
            judged = {i: quality_rules.judge(t) for i, t in before.items()}
            assert {i: r["text"] for i, r in after.items()} == {i: j[-1] for i, j in judged.items() if j[6]}
        elif name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.95 * len(good)
        elif name == "line_dedup":
            lines = [x for r in after.values() for x in r["text"].split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
            # Short lines stay exactly if no line before them is equal or one edit away.
            places = sorted((i, n, x) for i, t in before.items() for n, x in enumerate(t.split("\n")) if x.strip() and len(x) <= 20)
            stay = {x for k, (*_, x) in enumerate(places) if len(x) < 20 and not any(
                x == y or (min(len(x), len(y)) >= line_dedup.NEAR_FROM and one_edit(x, y)) for *_, y in places[:k])}
            assert stay == {x for x in lines if len(x) < 20}
        else:
            prints = [simhash.fingerprint(r["text"].encode()) for r in after.values()]
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    pieces = rows.collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    size = {}
    for r in pieces:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 4096 and len(size) <= -(-sum(size.values()) // 4096) + 2
    assert packing.pack(docs.limit(0), corpus_pipeline.TOKENIZER).count() == 0
