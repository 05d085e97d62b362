"""What must hold of results that SQL cannot compute, and of constant columns and paths for large data.

Each query counts, over its whole table, the rows that keep a promise; the SQL says how many there must be.
"""

from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.operators import text as X
from millrace.operators.cluster import KMeansClusters
from millrace.operators.encode import Binning
from millrace.operators.forest import IsolationForest
from millrace.operators.knn import affinity_graph, fuzzy_graph
from millrace.operators.linalg import Svd
from millrace.operators.profile import table_of
from millrace.operators.quantiles import percentiles
from millrace.operators.scale import QuantileTransform, Standardize
from millrace.operators.select import VarianceThreshold
from millrace.plans.autoclean import auto_clean
from workload.base import LINEITEM_NUMERIC, embedding_columns, query, rounded, union_sql


def holds(df, **tests):
    """Rows, and how many of them keep each test."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in tests.items()])


@query("kmeans_nearest", "SELECT count(*) AS rows, count(*) AS nearest, 3 AS clusters FROM lineitem")
def _(t):
    step = KMeansClusters(columns=["l_quantity", "l_extendedprice"], n_clusters=3).fit(t("lineitem"))
    centres = [list(map(float, c)) for c in step.model.clusterCenters()]
    to = [F.pow(F.col("l_quantity") - a, F.lit(2)) + F.pow(F.col("l_extendedprice") - b, F.lit(2)) for a, b in centres]
    own = F.element_at(F.array(*to), F.col("cluster") + 1)
    found = step.transform(t("lineitem")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(own <= F.least(*to) * (1 + 1e-9)).alias("nearest"),
                                              F.count_distinct("cluster").cast("int").alias("clusters"))
    return found


@query("bins_kmeans_nearest", "SELECT count(*) AS rows, count(*) AS nearest FROM events")
def _(t):
    """A value's bin is the one whose mean is nearest, but for a margin at the edges where the search ended."""
    df = Binning(columns=["value"], n_bins=5, strategy="kmeans").fit_transform(t("events").select("event_id", "value"))
    df = df.withColumnRenamed("value", "bin").join(t("events").select("event_id", "value"), "event_id")
    means = [r["m"] for r in df.groupBy("bin").agg(F.avg("value").alias("m")).orderBy("bin").collect()]  # five bins
    to = [F.abs(F.col("value") - m) for m in means]
    margin = 0.05 * (max(means) - min(means))
    return holds(df, nearest=F.element_at(F.array(*to), F.col("bin").cast("int") + 1) <= F.least(*to) + margin)


@query("quantile_normal_order", """SELECT count(*) AS rows, count(*) AS in_order, count(*) AS within, 0.0 AS median FROM orders""")
def _(t):
    df = t("orders").select("o_orderkey", F.col("o_totalprice").alias("x")).join(
        QuantileTransform(columns=["o_totalprice"], output_distribution="normal").fit_transform(
            t("orders").select("o_orderkey", "o_totalprice")), "o_orderkey")
    # Order is kept if ranks by value and by result agree; both are taken in coarse steps, so no task holds all rows.
    lines = percentiles(df, ["x", "o_totalprice"], [i / 100 for i in range(101)])
    places = [F.lit(0)], [F.lit(0)]
    for k, name in enumerate(("x", "o_totalprice")):
        for edge in lines[name][1:-1]:
            places[k].append(F.when(F.col(name) >= edge, 1).otherwise(0))
    apart = F.abs(sum(places[0][1:], places[0][0]) - sum(places[1][1:], places[1][0]))
    got = holds(df, in_order=apart <= 1, within=F.abs("o_totalprice") <= 5.1994)
    return got.withColumn("median", F.lit(round(abs(lines["o_totalprice"][50]), 1)))


@query("affinity_rows", "SELECT vec_id AS src, 90 AS neighbours, 1.0 AS total, round(ln(30), 3) AS entropy FROM embeddings")
def _(t):
    edges = affinity_graph(embedding_columns(t), "vec_id", perplexity=30)
    return edges.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("neighbours"), F.round(F.sum("p"), 6).alias("total"),
                                    F.round(-F.sum(F.col("p") * F.log("p")), 3).alias("entropy"))


@query("fuzzy_graph_rules", "SELECT count(*) AS nodes, count(*) AS symmetric, count(*) AS in_range, count(*) AS has_full FROM embeddings")
def _(t):
    edges = fuzzy_graph(embedding_columns(t), "vec_id", n_neighbors=15)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    both = edges.join(back, ["src", "dst"], "left")
    nodes = both.groupBy("src").agg(F.bool_and(F.coalesce(F.abs(F.col("weight") - F.col("back")) < 1e-9, F.lit(False))).alias("s"),
                                    F.bool_and((F.col("weight") > 0) & (F.col("weight") <= 1 + 1e-9)).alias("r"),
                                    (F.max("weight") > 1 - 1e-9).alias("f"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("s").alias("symmetric"), F.count_if("r").alias("in_range"),
                     F.count_if("f").alias("has_full"))


@query("word2vec_rules", """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents),
known AS (SELECT word FROM w WHERE word <> '' GROUP BY word HAVING count(*) >= 2)
SELECT doc_id, 100 AS length, count(known.word) = 0 AS zero FROM documents d LEFT JOIN w USING (doc_id)
LEFT JOIN known USING (word) GROUP BY doc_id""")
def _(t):
    docs = t("documents").select("doc_id", "text")
    found = X.Word2VecDocuments(text_column="text", key=["doc_id"]).fit(docs).transform(docs)
    return found.select("doc_id", F.size("w2v").alias("length"), F.forall("w2v", lambda x: x == 0).alias("zero"))


@query("topic_rules", "SELECT doc_id, 1.0 AS total, true AS dominant FROM documents")
def _(t):
    df = X.TopicModel(text_column="text").fit_transform(t("documents").select("doc_id", "text"))
    shares = [F.col(f"topic_{i}") for i in range(1, 6)]
    return df.select("doc_id", F.round(sum(shares[1:], shares[0]), 6).alias("total"),
                     (F.element_at(F.array(*shares), F.col("dominant_topic").cast("int")) == F.greatest(*shares)).alias("dominant"))


@query("isolation_forest_share", """SELECT count(*) AS rows, floor(count(*) * 0.05)::BIGINT AS flagged, 1::BIGINT AS planted
FROM customer""")
def _(t):
    """A twentieth is flagged, and a planted extreme row is among it."""
    df = t("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    far = df.limit(1).select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit(1e9).alias("c_acctbal"), F.lit(10_000).alias("c_nationkey"))
    with_far = df.unionByName(far)
    step = IsolationForest(columns=["c_acctbal", "c_nationkey"], contamination=0.05).fit(with_far)
    scored = IsolationForest.scored(with_far, step.params)
    return scored.agg(F.count_if(F.col("c_custkey") >= 0).alias("rows"),
                      F.count_if(F.col("is_outlier")).alias("flagged"),
                      F.count_if(F.col("is_outlier") & (F.col("c_custkey") < 0)).alias("planted"))


def standard(df, columns):
    """Columns whose mean is 0, and whose standard deviation is 1."""
    facts = [f for c in columns for f in (F.avg(c), F.stddev_pop(c))]
    got = df.agg(F.count(F.lit(1)), *facts).first()
    means, stds = got[1::2], got[2::2]
    return got[0], sum(abs(m) < 1e-6 for m in means), sum(abs(s - 1) < 1e-6 for s in stds)


@query("auto_clean_lineitem", """SELECT ceil(count(*) * 0.95)::BIGINT AS rows, 8::BIGINT AS centred, 8::BIGINT AS scaled,
  'isolation_forest_outlier_removal,one_hot_encoding,standardization' AS steps FROM lineitem""")
def _(t):
    """All columns and rows of `lineitem`: the forest removes a twentieth, and the numbers come out standardised."""
    done = auto_clean(t("lineitem"))
    rows, centred, scaled = standard(done.table, LINEITEM_NUMERIC)
    return table_of(t("lineitem"), [(rows, centred, scaled, ",".join(done.steps))], "rows long, centred long, scaled long, steps string")


@query("auto_clean_wide", "SELECT ceil(count(*) * 0.95)::BIGINT AS rows, 11::BIGINT AS components, 11::BIGINT AS centred FROM embeddings")
def _(t):
    """A table of 128 numbers ends in principal components."""
    df = embedding_columns(t).drop("vec_id")
    df = df.select("*", *[(F.col(c) * F.abs(F.col(c))).alias(f"s_{c}") for c in df.columns])
    table = auto_clean(df).table
    rows, centred, _ = standard(table, table.columns)
    return table_of(df, [(rows, sum(c.startswith("pca_") for c in table.columns), centred)], "rows long, components long, centred long")


# ---------------------------------------------------------------- constant columns

def with_constant(t):
    """`lineitem` with a constant whose partial sums round; dealt over several partitions."""
    return t("lineitem").select("l_quantity", "l_tax", F.lit(1e6 + 0.3).alias("k")).repartition(7)


@query("standardised_constant", "SELECT count(*) AS rows, count(*) AS zero FROM lineitem")
def _(t):
    return holds(Standardize().fit_transform(with_constant(t)), zero=F.col("k") == 0)


@query("svd_constant", "SELECT count(*) AS rows, count(*) AS zero FROM lineitem")
def _(t):
    """The third direction of two columns and a constant has no length."""
    return holds(Svd(n_components=3).fit_transform(with_constant(t)), zero=F.abs("SVD3") < 1e-6)


@query("variance_threshold_constant", "SELECT unnest(['l_quantity', 'l_tax']) AS kept, count(*) AS rows FROM lineitem")
def _(t):
    df = VarianceThreshold().fit_transform(with_constant(t))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*map(F.lit, df.columns))).alias("kept"), "rows")


@query("correlation_constant", """SELECT * FROM (VALUES ('l_quantity', 'l_quantity', 1.0), ('l_tax', 'l_tax', 1.0), ('k', 'k', NULL),
  ('l_quantity', 'k', NULL), ('k', 'l_quantity', NULL), ('l_tax', 'k', NULL), ('k', 'l_tax', NULL)) v(row_col, col_col, value)
UNION ALL SELECT a, b, round(corr(l_quantity, l_tax), 6) FROM lineitem, (VALUES ('l_quantity', 'l_tax'), ('l_tax', 'l_quantity')) n(a, b)
GROUP BY a, b""")
def _(t):
    return rounded(P.correlation_matrix(with_constant(t)))


@query("scale_spread_constant", "SELECT round(stddev_samp(l_quantity) / stddev_samp(l_tax), 6) AS spread FROM lineitem")
def _(t):
    df = with_constant(t)
    return rounded(table_of(df, [(P.scale_spread(P.base_facts(df)),)], "spread double"))


# ---------------------------------------------------------------- the path for large data

@query("percentiles_narrowed", union_sql([f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value
  FROM lineitem""" for c in LINEITEM_NUMERIC for p in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)]))
def _(t):
    """Exact percentiles by narrowing, as any large table takes them."""
    df, probs = t("lineitem"), [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = percentiles(df, LINEITEM_NUMERIC, probs, small_cells=0)
    return rounded(table_of(df, [(c, p, v) for c in LINEITEM_NUMERIC for p, v in zip(probs, found[c])],
                            "column string, p double, value double"))
