"""Licenses by windows, and helper columns that give way to a caller's."""

import random
from zlib import crc32

import numpy as np
import pytest

from millrace.llm import knn_quality, license_scan, line_dedup, oracles, quality_rules
from tests.llm.test_documents import against_sql

PLACES = [
    ("All of the people who came had rights to speak and the seats were reserved for them", ""),
    ("Licensed to the public under a new law which the city of Nd by 4 people and cc and 0 others signed", ""),
    ("all rights are reserved", "all-rights-reserved"),
    ("all the rights are reserved", ""),
    ("all all rights " + "x " * 50 + "all rights reserved", "all-rights-reserved"),
    ("// SPDX-License-Identifier: MIT", "mit"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
    ("SPDX-License-Identifier: Apache-2.0", "apache"),
    ("Distributed under the GNU GPL v3", "gpl"),
    ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Redistributions of source code must retain the above copyright\n# notice, this list of conditions and the following disclaimer.", "bsd"),
    ("all " * 3000 + "rights", ""),
    (None, "")]


def test_licenses_stand_in_one_window(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLACES)], "doc_id long, text string")
    got = license_scan.scan(df)
    assert {r["doc_id"]: r["labels"] for r in got.collect()} == {i: label for i, (_, label) in enumerate(PLACES)}
    against_sql(spark, oracles.LICENSE_SCAN, got, documents=df)


def test_helper_columns_give_way(spark):
    words = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, words, 5), (2, f"{words}\nown line", 6)], "doc_id long, text string, n_chars int")
    names = ["quality", "_quality", "gone", "GONE_id", "gone_t", "parts", "kept_text", "__gone", "id", "t"]
    df = df.selectExpr("*", *[f"'{n}' as {n}" for n in names])
    for made, texts in ((quality_rules.clean(df), [words, f"{words}\nown line"]), (line_dedup.without_repeated_lines(df), [words, "own line"])):
        rows = made.orderBy("doc_id").collect()
        assert made.columns == df.columns and [r["text"] for r in rows] == texts
        assert all(r[n] == n for r in rows for n in names)


@pytest.mark.parametrize("n,wide", [(3, 4), (7, 8), (25, 30)])
def test_span(n, wide):
    assert license_scan.span(n) == wide


def test_quality_vote_learns_wording(spark):
    """Both classes have words of five small letters, so only the words tell them apart."""
    rng = random.Random(12)
    words = {1: ["river", "stone", "green", "walks", "cloud", "night"], 0: ["cheap", "money", "sales", "prize", "deals", "bonus"]}
    shared = ["there", "which", "about", "after"]
    rows = [(i, " ".join(rng.choice(words[i % 2] + shared) for _ in range(40))) for i in range(400)] + [(900, None), (901, "words never seen before")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "'y' as __score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in knn_quality.score(df, labels).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(400) if crc32(str(i).encode()) % 3 == 1)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = knn_quality.keep_good(df, df, labels)
    assert kept.columns == df.columns and {r["score"] + r["__score"] for r in kept.collect()} == {"xy"}


def test_leading_eigenvectors_hold_one_matrix():
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 60)) * np.linspace(5, 1, 60) @ rng.normal(size=(60, 900)) + rng.normal(size=(900, 900))
    gram = x @ x.T
    values, vectors = np.linalg.eigh(gram)
    tracemalloc.start()
    got, left = knn_quality._leading(gram, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, values[::-1][:20], rtol=1e-9)
    assert np.allclose(left @ left.T, vectors[:, -20:] @ vectors[:, -20:].T, atol=1e-4)
    assert peak < 3 * gram.nbytes
