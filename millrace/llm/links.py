"""Connected components of links between nodes, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup_join
from millrace.runtime import settle, shuffled_join

MAX_ROUNDS = 60  # far above the logarithm of any number of nodes
FEW = 100_000  # links whose least neighbours, two numbers each, are looked up by broadcast


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Every (u, v) with the least of u and its neighbours as `m`; hot nodes are looked up by broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return lookup_join(edges, least, "u", "n", max(total, 1), small=total <= FEW)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b): root is the least node that it reaches.

    Links may repeat and point either way; loops and nulls are left out. Each round is written to the shared
    folder, so that a lost executor costs one round. Nodes without links do not appear.
    """
    edges = settle(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both, 2 * now["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u != v").distinct())
        small = _star(large, now["n"]).select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = settle(small.filter("u != v").distinct(), "links")
    raise RuntimeError("components did not settle")


def least_ids(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (id, node, ...) with `component`: the smallest id of all rows whose nodes the links (a, b) join.

    A row without a node is alone. A null id is the smallest only if there is no other.
    """
    return least_in(rows, components(found))


def least_in(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """As least_ids, for components that are known: `roots` has node, root of every linked node."""
    nodes = settle(rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("w")), "nodes")
    joined = shuffled_join(nodes, roots, "node", "left")
    joined = settle(joined.select("node", "least", "w", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "nodes")
    # Only linked nodes need their component's least id.
    linked = joined.filter("linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"), F.sum("w").alias("size"))
    total = max(rows.count(), 1)
    in_links = lookup_join(linked.select("node", "w", "root"), least, "root", "size", total, small=False)
    table = (in_links.select("node", "w", "component")
             .unionByName(joined.filter("not linked").select("node", "w", F.col("least").alias("component"))))
    # Looked up twice, for hot nodes and the rest: settled, or its joins would stand in the last plan twice as well.
    table = settle(table, "components")
    alone = rows.filter("node is null").withColumn("component", F.col("id"))
    return lookup_join(rows.filter("node is not null"), table, "node", "w", total, small=False).select(*rows.columns, "component").unionByName(alone)
