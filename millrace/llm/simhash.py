"""SimHash near-duplicates by meet-in-the-middle ball hashing.

The 64-bit fingerprints link at `RADIUS` = 3 or fewer differing bits. Balls of half the radius meet: if each fingerprint
emits itself and its variants at 1 bit, 65 in all, two that differ in 1 or 2 bits share a variant. Two at 3 bits
need a variant at 1 bit of the one and at 2 bits of the other. The ball of 2 has 2,081 points, so the work is split:

* Near round: the 65 variants, and a link from each member of a variant to the least one. All at 1 or 2 bits are joined, and
  links grow with the members, never with their pairs. Copies with few changes end up in few components here.
* Far round, for distance 3 between components of the near round only. One of three blocks of bits is left out and what is left
  is emitted with its variants at 1 bit, 131 keys in all three. A key is of use only if it holds two or more components. Where
  the 3 bits lie says who has to list which points: all in one block, or two there and one outside (the block that holds
  most is left out: a member unchanged outside lists the block at 1 bit, and at 2 bits for another unchanged one; a member
  changed outside lists it at 1 bit for an unchanged one), or one in each (the first is left out: a member changed in
  the second lists the block as it is, for one changed in the third, which lists it at 1 bit). Only bits in which the
  members of a key differ are listed. On a point the nearest member, at 0 or 1 bit, is the hub of the others.

Rows of a variant are combined by partial aggregation before the shuffle and joined back by a join that Spark can
split, so a group of near copies isn't held by one task. Equal fingerprints are one node, and links are verified by their bits.

Defined cases: a null or empty text has fingerprint zero, which links like any other; one or two words make one
shingle; repeated rows keep one row each; a null id takes part, but is never the smallest unless it is alone; an
empty table gives an empty one; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import bounded_batches
from millrace.llm.links import FEW, components, least_in
from millrace.operators.lookup import lookup_join
from millrace.runtime import settle, shuffled_join
from millrace.schema import col

RADIUS = 3
BLOCKS = [(0, 22), (22, 43), (43, 64)]  # bit ranges, of which one is left out at a time
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    """Signed 64-bit fingerprint of the XXH64 of all 3-word shingles, ASCII letters in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp of every row."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t.encode()) for t in texts], dtype="int64")

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return bounded_batches(docs).select(col(id_col).alias("id"), run(text).alias("fp"))


def _masks(bits: list[int]) -> Column:
    """An array of 64-bit masks to explode."""
    return F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in bits])


def _balls(fps: DataFrame) -> DataFrame:
    """a, b: links that join exactly what chains of at most 2 bits join."""
    ball = fps.select("fp", F.explode(_masks([0, *[1 << i for i in range(64)]])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    hubs = ball.groupBy("v").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).filter("hub != other").select("v", "hub")
    return shuffled_join(ball, hubs, "v").filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _far_points(labelled: DataFrame, begin: int, end: int) -> DataFrame:
    """fp, label, p: points on which fingerprints of different labels meet that differ in 3 bits, most of them in this block,
    or one in each block if this is the first."""
    inside = [1 << i for i in range(begin, end)]
    outside = [1 << i for i in range(64) if not begin <= i < end]
    block_mask = _masks([sum(inside)])[0]
    keep = F.col("fp").bitwiseAND(_masks([sum(outside)])[0])
    keys = labelled.select("fp", "label", F.explode(_masks([0, *outside])).alias("flip")).select(
        "fp", "label", keep.bitwiseXOR(F.col("flip")).alias("v"))
    open_ = keys.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("v")
    changed = F.col("v").bitwiseXOR(keep)
    second = _masks([sum(1 << i for i in range(*BLOCKS[1]))])[0]
    role = (F.when(changed == 0, "same").when(changed.bitwiseAND(second) != 0, "second").otherwise("third") if begin == 0
            else F.when(changed == 0, "same").otherwise("other"))
    members = settle(shuffled_join(keys, open_, "v", "left_semi").withColumn("role", role), "members")
    ends = [f(F.when(F.col("role") == r if r != "changed" else F.col("role") != "same", F.col("label"))).alias(f"{r}_{name}")
            for r in ("same", "changed", "second", "third") for name, f in (("low", F.min), ("high", F.max))]
    facts = members.groupBy("v").agg(F.expr("bit_or(fp)").bitwiseXOR(F.expr("bit_and(fp)")).alias("apart"), *ends)

    def meets(r: str) -> Column:
        """A member of another label with role r is on the key."""
        return F.coalesce((F.col(f"{r}_low") != F.col("label")) | (F.col(f"{r}_high") != F.col("label")), F.lit(False))

    seen = shuffled_join(members, facts, "v").select(
        "fp", "label", "v", "apart", "role", F.col("fp").bitwiseAND(block_mask).alias("block"), meets("same").alias("to_same"),
        meets("changed").alias("to_changed"), meets("second").alias("to_second"), meets("third").alias("to_third"))

    def listed(rows: DataFrame, flips: Column) -> DataFrame:
        # Members of a label with one reading of the block lead to the same points. Dealt anew, since a key may hold many.
        rows = rows.groupBy("v", "apart", "label", "block", "wide").agg(F.min("fp").alias("fp")).repartition("fp", "v")
        useful = F.filter(flips, lambda x: x.bitwiseAND(F.bitwise_not(F.col("apart"))) == 0)
        base = F.col("v").bitwiseOR(F.col("block"))
        return rows.select("fp", "label", F.explode(F.transform(useful, lambda x: base.bitwiseXOR(x))).alias("p"))

    same = F.col("role") == "same"
    most = seen.filter((same & (F.col("to_same") | F.col("to_changed"))) | (~same & F.col("to_same"))).withColumn("wide", same & F.col("to_same"))
    far = [x | y for i, x in enumerate(inside) for y in inside[:i]]
    points = listed(most, F.when(F.col("wide"), _masks(inside + far)).otherwise(_masks(inside)))
    if begin == 0:
        third = F.col("role") == "third"
        one_each = seen.filter((third & F.col("to_second")) | ((F.col("role") == "second") & F.col("to_third"))).withColumn("wide", third)
        points = points.unionByName(listed(one_each, F.when(F.col("wide"), _masks(inside)).otherwise(_masks([0]))))
    return points


def _nearest(points: DataFrame) -> DataFrame:
    """One row of a label on a point, the nearest: it stands for the others, which are joined to it already."""
    cost = F.bit_count(F.col("fp").bitwiseXOR(F.col("p")))
    return points.groupBy("label", "p").agg(F.min(F.struct(cost.alias("cost"), "fp", "label")).alias("m"))


def _rounds(fps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The near round's links (a, b), each `fp` with the `label` of its near component and whether it has company there, and the
    far round's links (a, b, from, to) with the labels that they join."""
    near = settle(_balls(fps), "near")
    roots = components(near)
    labelled = settle(fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("label"), F.col("root").isNotNull().alias("joined")), "labelled")
    # One block after the other: plans of all three at once take most of the driver's memory.
    parts = [settle(_nearest(_far_points(labelled, begin, end)), "points") for begin, end in BLOCKS]
    points = settle(_nearest(reduce(DataFrame.unionByName, [p.select("m.*", "p") for p in parts])), "points")
    hubs = points.groupBy("p").agg(F.min("m").alias("hub"), F.count("*").alias("n")).filter("n > 1 and hub.cost <= 1")
    far = shuffled_join(points, hubs.select("p", "hub"), "p").filter("hub.fp != m.fp").select(
        F.col("m.fp").alias("a"), F.col("hub.fp").alias("b"), F.col("m.label").alias("from"), F.col("hub.label").alias("to"))
    return near, labelled, far.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def links(fps: DataFrame) -> DataFrame:
    """a, b for distinct fingerprints `fp`: links that join exactly those that chains of <= 3 bits join."""
    near, _, far = _rounds(fps)
    return near.unionByName(far.select("a", "b")).distinct()


def roots(fps: DataFrame) -> DataFrame:
    """node, root for every fingerprint that is linked: components of the far round over the labels of the near one, so that
    what the near round has joined is not joined again."""
    _, labelled, far = _rounds(fps)
    further = settle(components(far.select(F.col("from").alias("a"), F.col("to").alias("b"))), "further")
    if further.count() <= FEW:
        found = labelled.join(F.broadcast(further), labelled["label"] == further["node"], "left")
    else:
        sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
        table = further.withColumnRenamed("node", "label").join(sizes, "label")
        found = lookup_join(labelled, table, "label", "n", max(labelled.count(), 1), small=False)
    return found.filter(F.col("joined") | F.col("root").isNotNull()).select(F.col("fp").alias("node"), F.coalesce("root", "label").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component (the smallest id that is reachable, itself included) of every row."""
    rows = settle(fingerprints(docs, id_col, text_col), "simhash").withColumnRenamed("fp", "node")
    fps = settle(rows.select(F.col("node").alias("fp")).distinct(), "nodes")
    return least_in(rows, roots(fps)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return classes(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, with one row of each component: that of the smallest id.

    Rows of one id count as one document, which stays if any of them leads a component; equal rows become one.
    """
    found = settle(classes(docs, id_col, text_col), "classes")
    leads = found.groupBy("id").agg(F.max(F.col("id").eqNullSafe(F.col("component")).cast("int")).alias("leads"),
                                    F.count("*").alias("n"))
    odd = settle(leads.filter("leads = 0 or n > 1").select("id", "leads"), "leads")
    # The whole row is one column meanwhile, so that no name of it can clash.
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("key"), col(text_col).alias("text"))
    once = rows.join(odd, F.col("key").eqNullSafe(F.col("id")), "left_anti")
    again = rows.join(odd.filter("leads = 1").select("id"), F.col("key").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["key", "text"])
    return once.unionByName(again).select("row.*")
