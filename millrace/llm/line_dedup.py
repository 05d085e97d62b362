"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier line is equal or one edit away.

Lines are cut at line breaks and ordered by (id, line number), null ids last. Equal lines are one class, held by two
64-bit hashes. Two different lines are one edit (insertion, deletion or substitution of a character) apart exactly if
deleting at most one character from each gives the same string. Emitting all those variants of all lines would be the
whole text times its line length, so a lossless filter comes first: with the shorter line's length cut into `PARTS`
segments, the edit falls into one of them, and the two lines agree on all the rest. Lines share such a key only if
they agree on all but one segment. A line whose keys are all its own has no partner; the others emit the variants
that delete from the segments in question, as hashed keys. On one variant, all lines that miss the same character
position are one edit apart, and so is the line that equals the variant from all of them, so each line takes the
earliest of these; no pairs are listed. The pair found is verified by its edit distance.

Near matches are looked for where the shorter line has `NEAR_FROM` characters or more, so that something is left in common;
of shorter lines any two would be one edit apart, so they go if equal.

Defined cases: null and empty texts have no lines; lines without a word never go and match nothing; rows that share an
id are one document, so equal line numbers of such rows don't remove each other; equal lines within one document go
but for the first; lines of any length are taken whole; an empty table gives an empty result; `repeated_lines` reads
the id and the text column only, and `without_repeated_lines` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.names import free_names
from millrace.operators.lookup import lookup_join
from millrace.runtime import settle, shuffled_join
from millrace.schema import col

PARTS = 4
NEAR_FROM = 2
ROW_BYTES = 160
BROADCAST_BYTES = 16 << 20  # of the places that are looked up; the driver holds several copies while it builds their table
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text), no (from 0), line and its hashes h1, h2, for all lines with a word."""
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    lines = texts.select("id", "t", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.filter(F.col("line").rlike(r"\S")).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _place(id_: str = "id", no: str = "no") -> Column:
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(no).alias("no"))


def _keys() -> list[Column]:
    """For l = n, then l = n - 1 as the shorter length, and each segment: the hash of all but that segment."""
    n, out = F.length("line"), []
    for shorter in (0, 1):
        size = n - shorter
        for j in range(PARTS):
            begin, end = F.floor(size * j / PARTS).cast("int"), F.floor(size * (j + 1) / PARTS).cast("int")
            rest = F.xxhash64(size, F.lit(j), F.substr("line", F.lit(1), begin), F.right("line", size - end))
            out.append(F.when(size >= NEAR_FROM, rest))
    return out


def deletions(line: str, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the variants that the key slots in the bit mask ask for, and the position each misses (-1: none)."""
    values = (np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * _MIX
    values ^= values >> np.uint64(29)
    n = len(values)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:n])])
    shifted = np.concatenate([[np.uint64(0), np.uint64(0)], np.cumsum(values[1:] * powers[:n - 1])])
    wanted = np.zeros(n, bool)
    whole = False
    for slot in range(2 * PARTS):
        if slots >> slot & 1:
            shorter, j = divmod(slot, PARTS)
            size = n - shorter
            wanted[size * j // PARTS:size * (j + 1) // PARTS + shorter] = True
            whole |= not shorter
    at = np.flatnonzero(wanted)
    hashes = upto[at] + (shifted[n] - shifted[at + 1]) + powers[n - 1:n]
    if whole:
        hashes = np.concatenate([hashes, upto[n:] + powers[n:]])
        at = np.append(at, -1)
    return hashes.view(np.int64), at


def near_matches(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, near: for each class of lines the earliest place of a line one edit away, if that is earlier."""
    keys = (classes.select("h1", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(2 * PARTS)])).alias("slot", "key"))
            .filter("key is not null"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("key")
    chosen = shuffled_join(keys, shared, "key", "left_semi").groupBy("h1").agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("slots"))
    chosen = settle(shuffled_join(chosen, classes.select("h1", "h2", "first"), "h1"), "chosen")
    # A row of the broadcast table holds nine numbers, its key four, and both the id.
    size = F.sum(F.lit(ROW_BYTES) + 2 * F.coalesce(F.octet_length(F.col("first.id").cast("string")), F.lit(0)))
    few = (chosen.agg(size).first()[0] or 0) <= BROADCAST_BYTES
    wanted = chosen.select(F.col("h1"), F.col("h2"), "slots", "first", F.col("first.id").alias("fid"), F.col("first.no").alias("fno"))
    here = lines_of(docs, id_col, text_col)
    same = ((here["h1"] == wanted["h1"]) & (here["h2"] == wanted["h2"]) & (here["no"] == wanted["fno"])
            & here["id"].eqNullSafe(wanted["fid"]))
    lines = (here.join(F.broadcast(wanted), same) if few else shuffled_join(here, wanted, same)).select(
        here["h1"], here["h2"], here["line"], "slots", "first")
    lines = settle(lines, "lines")

    @F.pandas_udf("array<struct<v:bigint,p:int>>")
    def variants(texts: pd.Series, masks: pd.Series) -> pd.Series:
        rows = (deletions(t, m) for t, m in zip(texts, masks))
        return pd.Series([[{"v": v, "p": p} for v, p in zip(h.tolist(), at.tolist())] for h, at in rows], dtype=object)

    made = (lines.select("h1", "h2", "first", F.explode(variants("line", "slots")).alias("e"))
            .select("h1", "h2", "first", "e.v", "e.p"))
    whole = F.col("p") == -1
    by_variant, by_place = Window.partitionBy("v"), Window.partitionBy("v", "p")
    found = (made.withColumn("many", F.count("*").over(by_variant)).filter("many > 1")
             .withColumn("base", F.min(F.when(whole, F.col("first"))).over(by_variant))
             .withColumn("longer", F.min(F.when(~whole, F.col("first"))).over(by_variant))
             .withColumn("same", F.min("first").over(by_place)))
    best = F.when(whole, F.col("longer")).otherwise(F.least("base", "same"))
    earliest = (found.groupBy("h1", "h2").agg(F.min(best).alias("near"), F.min("first").alias("first"))
                .filter("near < first").select("h1", "h2", "near"))
    # Verify the pair itself.
    other = lines.select(F.col("first").alias("near"), F.col("line").alias("partner"))
    return (earliest.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(other, "near")
            .filter(F.levenshtein("line", "partner", 1) == 1).select("h1", "h2", "near").distinct())


def marked_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that goes: id, t (hash of its row's text), no, match (the earliest place), n_edits."""
    lines = lines_of(docs, id_col, text_col)
    facts = {f"k{i}": k for i, k in enumerate(_keys())}
    classes = (lines.withColumns(facts).groupBy("h1", "h2")
               .agg(F.min(_place()).alias("first"), F.count("*").alias("n"), *[F.max(k).alias(k) for k in facts]))
    classes = settle(classes, "classes")
    near = near_matches(docs, classes, id_col, text_col)
    known = classes.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left")
    known = known.filter("n > 1 or near is not null").select(
        F.struct("h1", "h2").alias("h"), "n", F.coalesce("near", "first").alias("match"),
        F.when(F.col("near").isNull(), 0).otherwise(1).alias("n_edits"))
    known = settle(known, "known")
    total = classes.agg(F.sum("n")).first()[0] or 0
    thin = lines.select("id", "t", "no", F.struct("h1", "h2").alias("h"))
    marked = lookup_join(thin, known, "h", "n", max(total, 1), small=False)
    return marked.filter(F.col("match") < _place())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that goes: id, line_no, match_doc_id, match_line_no (the earliest match), n_edits."""
    return marked_lines(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("no").alias("line_no"), F.col("match.id").alias("match_doc_id"),
        F.col("match.no").alias("match_line_no"), "n_edits")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           length_col: str = "n_chars") -> DataFrame:
    """The documents without those lines, all columns in place; a document left without a word goes."""
    key, h, gone, split, left_over = free_names(docs, "gone_id", "gone_t", "gone", "parts", "kept_text")
    marked = (marked_lines(docs, id_col, text_col).groupBy(F.col("id").alias(key), F.col("t").alias(h))
              .agg(F.collect_set("no").alias(gone)))
    # Rows that share an id are told apart by their text, so only the row that holds a line loses it.
    same = col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(col(text_col).cast("string")) == F.col(h))
    joined = docs.join(marked, same, "left")
    parts = F.split(col(text_col), "\n", -1)
    # The parts are used twice, so Spark keeps them as a column and does not split anew for every line.
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(split), i)), "\n"))
    worded = F.size(F.filter(parts, lambda line: line.rlike(r"\S")))
    left = joined.filter(F.col(gone).isNull() | (F.size(gone) < worded))
    cleaned = left.withColumn(split, parts).withColumn(left_over, text)
    return cleaned.select(*[F.col(left_over).alias(c) if c == text_col else
                            F.length(left_over).cast(docs.schema[c].dataType).alias(c) if c == length_col else col(c)
                            for c in docs.columns])
