"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

Only DataFrame functions are used. A block is a sentence, over all the lines it is wrapped to: what stands between marks
of .!? before white space (but for "v. 2") and between lines without a word. A template's words are a set; it is found in a
block, of any length, if at least `THRESHOLD` of them stand in one window of the block, which is as many consecutive words
as the template has and a fifth more, one at least (`span`). So words that only happen to be in one long sentence are no license.
The join is exact:
* the words of all templates are ordered by how often they occur in all documents, rarest first;
* prefix filter: a block that meets the threshold holds one of a template's first n - ceil(t n) + 1 words, so only
  blocks with such a word go on;
* length filter: the block has at least ceil(t n) words;
* positional filter: if the first common word is the template's word number p, at most n - p words can be common;
* what is left is verified by the intersection with the block, then with each window that begins at a common word.
The templates are few and fixed, so their index is broadcast; nothing else is.

Defined cases: a null text counts as empty and gives no words, no labels and score 0; texts of any length are taken
whole; equal rows get equal results, row by row, and rows that share an id are kept apart by their text; an empty
table gives an empty one; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import settle
from millrace.schema import col

# Words are runs of ASCII letters and digits and of all characters outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A line without a word may hold comment marks.
SENTENCE_END = r"[.!?]+\s++(?![0-9])|\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*+\n"
THRESHOLD = 0.9

# Phrases of the base labels.
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]

# Sentences of public licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "spdx license identifier mit"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "spdx license identifier gpl 2 0"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("isc", "spdx license identifier isc"),
    ("mpl", "spdx license identifier mpl 2 0"),
    ("unlicense", "spdx license identifier unlicense"),
    ("gpl", "gnu gpl v2"),
    ("gpl", "gnu gpl v3"),
    ("gpl", "gnu gpl version 2"),
    ("gpl", "gnu gpl version 3"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license"),
]


def lowered(text: Column) -> Column:
    """Lower case of A-Z. lower() also turns two other letters into ASCII ones, so those are put out of the way."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _templates() -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and span of each template."""
    return [(i, label, sorted(set(text.split())), span(len(text.split()))) for i, (label, text) in enumerate(TEMPLATES)]


def span(n: int) -> int:
    """Words of the window that a template of n words is looked for in."""
    return n + max(1, n // 5)


def need(n: int) -> int:
    """Common words that a template of n words asks for."""
    return math.ceil(THRESHOLD * n - 1e-9)


def phrase_hits(low: Column) -> Column:
    """Array of (word number, label) of all places where a phrase stands."""
    words = words_of(low)
    triples = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"),
                           F.slice(words, 3, F.greatest(F.size(words), F.lit(1))).alias("c"))
    triples = triples.cast("array<struct<a:string,b:string,c:string>>")

    def hit(t: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            same = [t[k] == w for k, w in zip("abc", phrase)]
            test = same[0]
            for s in same[1:]:
                test = test & s
            out = F.when(test, F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("i"), out.alias("label"))

    found = F.filter(F.transform(triples, hit), lambda h: h["label"].isNotNull())
    none = F.array().cast("array<struct<i:bigint,label:string>>")
    return F.when(F.contains(low, F.lit("license")), found).otherwise(none)


def matches(docs: DataFrame) -> DataFrame:
    """id, h, label, containment for every block of `docs` (id, h, low) and template that meet the threshold."""
    spark = docs.sparkSession
    templates = _templates()
    vocabulary = sorted({w for _, _, words, _ in templates for w in words})
    tally = (docs.select(F.explode(words_of(F.col("low"))).alias("w")).filter(F.col("w").isin(vocabulary))
             .groupBy("w").agg(F.count("*").alias("n")))
    often = {r["w"]: r["n"] for r in tally.collect()}  # at most the vocabulary
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index, sets = [], []
    for i, label, words, wide in templates:
        ranked = sorted(words, key=order.__getitem__)
        n = len(ranked)
        sets.append((i, label, ranked, n, need(n), wide))
        index += [(w, i, p, n, need(n)) for p, w in enumerate(ranked[:n - need(n) + 1])]
    prefix = sorted({row[0] for row in index})
    blocks = (docs.select("id", "h", F.explode(F.split("low", SENTENCE_END)).alias("block"))
              .select("id", "h", words_of(F.col("block")).alias("words"))
              .filter(F.arrays_overlap("words", F.array(*map(F.lit, prefix)))))
    blocks = settle(blocks.distinct(), "blocks")
    index_df = F.broadcast(spark.createDataFrame(index, "w string, t int, p int, n int, need int"))
    sets_df = F.broadcast(spark.createDataFrame(sets, "t int, label string, ranked array<string>, n int, need int, wide int"))
    first = F.array_intersect("words", F.array(*map(F.lit, prefix)))
    size = F.size("words")
    candidates = (blocks.select("id", "h", "words", F.explode(first).alias("w")).join(index_df, "w")
                  .filter(size >= F.col("need"))
                  .groupBy("id", "h", "words", "t").agg(F.min("p").alias("p"), F.first("n").alias("n"), F.first("need").alias("need"))
                  .filter(F.col("n") - F.col("p") >= F.col("need")).drop("n", "need"))
    common = F.size(F.array_intersect("words", "ranked"))
    checked = candidates.join(sets_df, "t").filter(common >= F.col("need")).withColumn("most", _most_in_a_window())
    return checked.filter(F.col("most") >= F.col("need")).select("id", "h", "label", (F.col("most") / F.col("n")).alias("containment"))


def _most_in_a_window() -> Column:
    """The most words of `ranked` that stand in `wide` consecutive words of `words`."""
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    hits = F.filter(numbered, lambda x: F.array_contains("ranked", x["w"]))

    def most(found: Column) -> Column:
        def begun_at(x: Column, k: Column) -> Column:
            # At most `wide` hits lie in the window, so the work is in proportion to the hits.
            inside = F.filter(F.slice(found, k + 1, F.col("wide")), lambda y: y["i"] < x["i"] + F.col("wide"))
            return F.size(F.array_distinct(F.transform(inside, lambda y: y["w"])))

        return F.array_max(F.transform(found, begun_at))

    # The hits are bound to a variable, so that they are found once for all windows.
    return F.get(F.transform(F.array(hits), most), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is 1 where a phrase stands, else the best containment of a template found, else 0.
    """
    rows = docs.select(col(id_col).alias("id"), lowered(col(text_col).cast("string")).alias("low"))
    rows = rows.withColumn("h", F.xxhash64("low"))
    hits = rows.select("id", "h", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
                       phrase_hits(F.col("low")).alias("hits"))
    place = F.transform("hits", lambda x: x["i"])
    base = hits.select("id", "h", "n_words", F.size("hits").cast("long").alias("n_base"),
                       F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
                       F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["label"]))).alias("base"))
    found = (matches(rows).groupBy(F.col("id").alias("mid"), F.col("h").alias("mh"))
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("mid")) & (F.col("h") == F.col("mh")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
