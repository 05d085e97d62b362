import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from millrace.llm import knn_quality, license_scan, line_dedup, links, oracles, quality_rules, simhash


def against_sql(spark, sql, got, **tables):
    """Rows of a Spark result and of DuckDB SQL over the same small tables."""
    db = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()  # noqa: F841 - read by DuckDB
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM frame")
    want = db.execute(sql).df()
    have = got.toPandas()[list(want.columns)]
    plain = lambda df: sorted(str([None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) else x for x in r])
                              for r in df.astype(object).itertuples(index=False))
    assert plain(have) == plain(want)


TEXT = "The quick brown fox jumps over the lazy dog and runs far away from home today. "


def test_quality_rules_against_sql(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, None), (3, ""), (4, "   \n \n"), (5, "same three words " * 30),
            (6, "\n".join([" ".join(words), "a | b | c | d", "Click here to read more", "&&& %%% $$$ ###"])),
            (7, "\n".join(f"item{i} | thing{i} | part{i} | piece{i}" for i in range(30))),
            (8, " ".join([f"loud{i}!!" for i in range(70)]) + "\n" + " ".join(words[:20])),
            (9, " ".join(f"big{i}!!" for i in range(200))), (10, "dup line\n" * 5 + " ".join(words)),
            (11, " ".join(f"é{i}中\x0b" for i in range(55)) + "\x1c x"), (None, " ".join(words)), (13, "x" * 200_000),
            (14, "a b c a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'q' as __quality")
    got = quality_rules.measure(df)
    against_sql(spark, oracles.QUALITY_RULES, got.filter("doc_id is not null"), documents=df.filter("doc_id is not null").select("doc_id", "text"))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept[1] and kept[None] and kept[6] and kept[11] and not (kept[2] or kept[5] or kept[7] or kept[8] or kept[9])
    assert quality_rules.measure(df.limit(0)).count() == 0


def test_cleaned_documents_lose_failed_lines_only(spark):
    words = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{words}\n\nAll rights reserved.\n{words[::-1]}", 7, "x"), (2, None, 0, "y"), (3, words, 9, None)],
                               "doc_id long, text string, n_chars long, `a.b` string")
    rows = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert set(rows) == {1, 3} and rows[1]["text"] == f"{words}\n\n{words[::-1]}" and rows[3]["text"] == words
    assert rows[1]["n_chars"] == len(rows[1]["text"]) and rows[1].asDict()["a.b"] == "x"


def brute_lines(rows, near_from):
    lines = [((i is None, i or 0, n), i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    out = set()
    for place, i, n, x in lines:
        found = [(p, a, b, int(x != y)) for p, a, b, y in lines if p < place and
                 (x == y or min(len(x), len(y)) >= near_from and one_edit(x, y))]
        if found:
            p, a, b, _ = min(found)
            edits = min(f[3] for f in found if f[0] == p)
            out.add((i, n, a, b, edits))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


@pytest.mark.parametrize("few", [True, False])
def test_line_dedup_against_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    base = ["".join(rng.choice("abé中 ") for _ in range(rng.randrange(15, 60))) + "z" for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(3):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, what = rng.randrange(len(x)), rng.randrange(3)
                x[k:k + 1] = [] if what == 0 else [rng.choice("ab🙂"), x[k]] if what == 1 else [rng.choice("qé")]
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, " \n\t\n "), (203, "aaaaaaaaaaaaaaaaaaaaaaaa"), (204, "aaaaaaaaaaaaaaaaaaaaaaa"),
             (205, "aaaaaaaaaaaaaaaaaaaaaaab"), (206, "short\nshort\nshore"), (None, "aaaaaaaaaaaaaaaaaaaaaaaa"), (207, "y" * 30_000),
             (208, "y" * 29_999 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as line", "1 as h1").repartition(5)
    got = {tuple(r) for r in line_dedup.repeated_lines(df).collect()}
    assert got == brute_lines(rows, line_dedup.NEAR_FROM)
    assert {e for *_, e in got} == {0, 1}


def test_documents_without_repeated_lines(spark):
    long_ = "this line is long enough to have near matches"
    rows = [(2, f"b\n{long_}s\n\nown", 3, "p"), (1, f"a\n{long_}\n\na", 4, None), (3, "a\nb", 3, "q"), (4, "", 0, "r"), (5, None, None, "s"),
            (1, f"a\n{long_}\n\na", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `x.y` string")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.without_repeated_lines(df).collect()), key=str)
    first = (1, f"a\n{long_}\n", len(f"a\n{long_}\n"))
    assert got == sorted([first, first, (2, "b\n\nown", 6), (4, "", 0), (5, None, None)], key=str)
    assert line_dedup.without_repeated_lines(df.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(0, "common line"), (1, "alpha\ncommon line"), (1, "beta\nown line"), (None, "delta\ncommon line"), (None, "eps\nother line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    got = sorted(map(str, (tuple(r) for r in line_dedup.without_repeated_lines(df).collect())))
    assert got == sorted(map(str, [(i, t, len(t)) for i, t in [(0, "common line"), (1, "alpha"), (1, "beta\nown line"), (None, "delta"),
                                                              (None, "eps\nother line")]]))


def test_license_scan_against_sql(spark):
    rows = [(1, "Released under the MIT License. mit license"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."),
            (5, "This work is licensed under the GNU General Public License, version 3.\nApache\nlicense"),
            (6, "under the license we were released by mit friends and so on. All rights reserved!"), (7, "MIT-LICENSE mit  license Mit"),
            (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation things"),
            (9, "all " * 2000 + "rights reserved"), (10, "general public licenſe general public license"), (11, "K İ license mit")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as labels", "2 as h")
    got = license_scan.scan(df)
    against_sql(spark, oracles.LICENSE_SCAN, got, documents=df.select("doc_id", "text"))
    labels = {r["doc_id"]: (r["base_labels"], r["labels"], r["score"]) for r in got.collect()}
    assert labels[1] == ("mit", "mit", 1.0) and labels[4] == ("", "cc-by-nc", 1.0) and labels[2] == ("", "", 0.0)
    assert labels[8][1] == "mit" and 0.9 <= labels[8][2] < 1 and labels[9] == ("", "all-rights-reserved", 1.0)
    twice = spark.createDataFrame([(1, "mit license"), (1, "All rights reserved."), (1, "mit license"), (None, "mit license")], df.schema[:2])
    assert sorted((str(r["doc_id"]), r["labels"]) for r in license_scan.scan(twice).collect()) == [
        ("1", "all-rights-reserved"), ("1", "mit"), ("1", "mit"), ("None", "mit")]
    assert license_scan.scan(df.limit(0)).count() == 0


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation\nfiles"),
    ("mit", "# The above copyright notice and this permission notice shall be included in\n# all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("isc", " * Permission to use, copy, modify, and/or distribute this software for any\r\n * purpose with or without fee is hereby granted, provided"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
    ("gpl", "This program is free software; you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation"),
    ("", "All the seats are taken.\nRights are\n *\nreserved")]


def test_licenses_wrapped_over_lines_are_found(spark):
    df = spark.createDataFrame([(i, f"Copyright someone\n\n{text}\n\nmore") for i, (_, text) in enumerate(WRAPPED)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()} == {i: label for i, (label, _) in enumerate(WRAPPED)}
    more = df.union(spark.createDataFrame([(20, "gnu general public\nlicense version. 3 x"), (21, "all rights.\n\n2 reserved"),
                                           (22, "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n 2.0")], df.schema))
    against_sql(spark, oracles.LICENSE_SCAN, license_scan.scan(more), documents=more)


def test_short_lines_one_edit_apart_go_too(spark):
    lines = ["ab", "ac", "b", "c", "abc", "xabc", "bb", "中文", "中", "中文x", "a", "ba", "", "zz", "yzz", "éé", "éà"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    got = line_dedup.repeated_lines(df)
    against_sql(spark, oracles.LINE_DEDUP, got, documents=df)
    assert {r["doc_id"] for r in got.collect()} == {1, 4, 5, 6, 9, 11, 14, 16}


def test_licenses_in_long_blocks_against_brute_force(spark):
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(400)]
    texts = ["Copyright 2024 Example Media Group Ltd and its affiliates in Europe and North America, all rights reserved"]
    for _, template in license_scan.TEMPLATES:
        words = template.split()
        for keep in (len(words), len(words) - 1, len(words) - 3):
            words = words[:max(keep, 0)]
            texts.append(" ".join(rng.sample(filler, 300) + words + rng.sample(filler, 100)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, text in enumerate(texts):
        block = set(text.lower().replace(",", "").split())
        want[i] = ",".join(sorted({label for label, t in license_scan.TEMPLATES if 10 * len(block & set(t.split())) >= 9 * len(set(t.split()))}
                                  | {label for phrase, label in license_scan.PHRASES if " ".join(phrase) in text}))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert got == want and got[0] == "all-rights-reserved" and all(got[1 + 3 * k] for k in range(len(license_scan.TEMPLATES)))


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + [(None, 3), (700, 700)], "a long, b long")
    got = {r["node"]: r["root"] for r in links.components(df).collect()}
    assert got == brute_components([p for p in pairs if p[0] != p[1]])
    assert links.components(df.limit(0)).count() == 0


def test_links_join_what_three_bits_join(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            fps.add(x)
            spread = rng.choice([64, 16, 4])
            at = rng.randrange(0, 64 - spread + 1)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << (at + rng.randrange(spread))
    for at in ([0, 1, 2], [3, 30, 31], [5, 40, 50], [22, 23, 60], [43, 50, 63], [10, 11, 45], [21, 22, 43]):  # 3 bits in all ways over the blocks
        x = rng.getrandbits(64)
        fps |= {x, x ^ sum(1 << i for i in at)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in got)
    assert brute_components(got) == brute_components(want)


def test_points_of_near_copies_do_not_grow_with_the_group(spark):
    rng = random.Random(16)
    made = {}
    for m in (100, 400):
        x, fps = rng.getrandbits(64), set()
        while len(fps) < m:
            fps.add(x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        near = [(r["a"], r["b"]) for r in simhash._balls(df).collect()]
        root = {f: f for f in signed} | brute_components(near)
        labelled = spark.createDataFrame(list(root.items()), "fp long, label long")
        made[m] = sum(simhash._far_points(labelled, *block).count() for block in simhash.BLOCKS) / m
    assert made[400] <= made[100] + 1


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(300)]
        for _ in range(3):
            rows.append((len(rows), " ".join(text)))
            text[rng.randrange(300)] = "changed"
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One Two"), (504, "one\ttwo"), (505, rows[0][1].upper()), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as fp", "'z' as component").repartition(4)
    fp = {t: plain_fingerprint(t or "") for _, t in rows}
    values = sorted(set(fp.values()))
    root = {v: v for v in values} | brute_components([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in rows:
        r = root[fp[t]]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in rows)
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    df = df.selectExpr("*", "9 as __id", "8 as id", "7 as key", "6 as row")
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_quality_vote_learns_form(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "green", "walks", "over"]) for _ in range(40)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "CHEAP", "WIN"]) + "!!" for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(900, None), (901, ""), (2, bad()), (None, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as label", "'s' as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 0), (None, 1), (7, None), (5000, 1)], "doc_id long, quality int")
    got = knn_quality.score(df, labels).collect()
    from zlib import crc32
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
        if i is not None and i < 400:
            assert r["predicted"] == i % 2
    assert len(got) == len(rows)
    kept = knn_quality.keep_good(df, df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(1, 400, 2))
    # Held-out labels teach nothing: turning them over changes no score.
    turned = spark.createDataFrame([(i, 1 - i % 2 if crc32(str(i).encode()) % 3 == 1 else i % 2) for i in range(400)] + [(5, 0)], "doc_id long, quality int")
    again = {(r["doc_id"], r["score"]) for r in knn_quality.score(df, turned).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    assert {r["score"] for r in knn_quality.score(df, labels.limit(0)).collect()} == {0.5}
    assert knn_quality.score(df.limit(0), labels).count() == 0


def test_exact_cosines_decide_the_vote():
    rng = np.random.default_rng(1)
    bags = [knn_quality.terms("".join(rng.choice(list("abAB !.\n"), 80))) for _ in range(60)]
    labels = (rng.random(60) > 0.5).astype(float)
    model = knn_quality.train(bags, labels)
    texts = ["".join(rng.choice(list("abAB !.\n"), 80)) for _ in range(20)]
    vectors = model.project([knn_quality.terms(t) for t in texts])
    for v, s in zip(vectors, model.score(texts)):
        cos = model.vectors @ v
        near = np.argsort(-cos)[:knn_quality.NEIGHBOURS]
        w = np.clip(cos[near], 0, 1) ** knn_quality.SHARPNESS
        assert s == pytest.approx((w * labels[near]).sum() / w.sum())
