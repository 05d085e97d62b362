"""Linear algebra, clusters and neighbour graphs."""

from pyspark.sql import functions as F

from millrace.operators import linalg as L
from millrace.operators.cluster import KMeansClusters
from millrace.operators.knn import affinity_graph, fuzzy_graph, knn_edges
from millrace.operators.profile import table_of
from workload.base import LINEITEM_NUMERIC, embedding_columns, query, rounded, union_sql


@query("covariance_matrix", union_sql([
    f"SELECT '{a}' AS row_col, '{b}' AS col_col, round(covar_samp({a}::DOUBLE, {b}::DOUBLE), 3) + 0.0 AS value FROM lineitem"
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC]))
def _(t):
    return rounded(L.covariance_matrix(t("lineitem")), 3)


WIDE = 64
# All pairs of two entries; the many-column path adds up Arrow batches.
COV_LONG = """WITH c AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'e' || a.i AS row_col, 'e' || b.i AS col_col, round(covar_samp(a.x, b.x), 6) + 0.0 AS value
FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i"""


@query("covariance_matrix_wide", COV_LONG)
def _(t):
    return rounded(L.covariance_matrix(embedding_columns(t).drop("vec_id")))


TWO = """c AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, o_orderkey FROM orders),
m AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM c),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2,
  0.5 * atan2(2 * b, a - c) AS th FROM m),
v AS (SELECT *, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS s1,
  CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN sign(-sin(th)) ELSE sign(cos(th)) END AS s2 FROM e)"""


@query("eigen_decomposition", f"""WITH {TWO}
SELECT 1 AS component, round(l1, 3) AS eigenvalue, round(l1 / (a + c), 6) AS explained_ratio, round(l1 / (a + c), 6) AS cumulative FROM v
UNION ALL SELECT 2, round(l2, 3), round(l2 / (a + c), 6), 1.0 FROM v""")
def _(t):
    found = L.eigen_decomposition(t("orders"), ["o_custkey", "o_totalprice"])
    return found.select("component", F.round("eigenvalue", 3).alias("eigenvalue"),
                        F.round("explained_ratio", 6).alias("explained_ratio"), F.round("cumulative", 6).alias("cumulative"))


@query("eigenvectors", f"""WITH {TWO}
SELECT 1 AS component, 'o_custkey' AS "column", round(s1 * cos(th), 6) AS loading FROM v
UNION ALL SELECT 1, 'o_totalprice', round(s1 * sin(th), 6) FROM v
UNION ALL SELECT 2, 'o_custkey', round(s2 * -sin(th), 6) FROM v
UNION ALL SELECT 2, 'o_totalprice', round(s2 * cos(th), 6) FROM v""")
def _(t):
    return rounded(L.eigenvectors(t("orders"), ["o_custkey", "o_totalprice"]))


@query("pca_scores", f"""WITH {TWO}
SELECT c.o_orderkey, round(s1 * ((x - mx) * cos(th) + (y - my) * sin(th)), 2) + 0.0 AS "PC1",
  round(s2 * ((x - mx) * -sin(th) + (y - my) * cos(th)), 2) + 0.0 AS "PC2" FROM c, v""")
def _(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(L.Pca(exclude=["o_orderkey"]).fit_transform(df), 2)


@query("pca_variances", """WITH c AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT round(sum(v), 6) AS total, true AS matches FROM (SELECT var_samp(x) AS v FROM c GROUP BY i)""")
def _(t):
    """The variances of all components add up to the total variance, and each is its eigenvalue."""
    df = embedding_columns(t)
    model = L.Pca(n_components=WIDE, exclude=["vec_id"]).fit(df)
    scores = model.transform(df)
    got = scores.agg(*[F.var_samp(c) for c in scores.columns if c != "vec_id"]).first()
    explained = model.metadata["explained_variance"]
    same = all(abs(a - b) < 1e-9 for a, b in zip(got, explained))
    return rounded(table_of(df, [(sum(got), same)], "total double, matches boolean"))


@query("svd_scores", """WITH c AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders),
m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, corr(x, y) AS r FROM c),
z AS (SELECT o_orderkey, (x - mx) / sx AS x, (y - my) / sy AS y, r FROM c, m)
SELECT o_orderkey, round(abs(x + CASE WHEN r > 0 THEN y ELSE -y END) / sqrt(2), 6) AS first,
  round(abs(x - CASE WHEN r > 0 THEN y ELSE -y END) / sqrt(2), 6) AS second FROM z""")
def _(t):
    """Of two standardised columns the directions are the two diagonals; signs are left out."""
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    scores = L.Svd(exclude=["o_orderkey"]).fit_transform(df)
    return scores.select("o_orderkey", F.round(F.abs("SVD1"), 6).alias("first"), F.round(F.abs("SVD2"), 6).alias("second"))


@query("svd_singular_values", """WITH c AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT round(count(*)::DOUBLE, 3) AS sum_of_squares FROM c""")
def _(t):
    df = embedding_columns(t)
    model = L.Svd(n_components=WIDE, exclude=["vec_id"]).fit(df)
    return rounded(table_of(df, [(sum(s * s for s in model.metadata["singular_values"]),)], "sum_of_squares double"), 3)


@query("kmeans_clusters")
def _(t):
    step = KMeansClusters(columns=["l_quantity", "l_extendedprice"], n_clusters=3)
    return step.fit_transform(t("lineitem"))


@query("neighbour_edges", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT src, dst, rank::INT AS rank, round(dist, 6) AS dist FROM (SELECT a.vec_id AS src, b.vec_id AS dst,
  list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 15""")
def _(t):
    return rounded(knn_edges(embedding_columns(t), "vec_id", 15))


@query("neighbour_edges_narrow", """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)
SELECT src, dst, rank::INT AS rank, round(sqrt(dist), 6) AS dist FROM (SELECT a.p_partkey AS src, b.p_partkey AS dst,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist, row_number() OVER (PARTITION BY a.p_partkey
  ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.p_partkey) AS rank
  FROM p a JOIN p b ON a.p_partkey <> b.p_partkey) WHERE rank <= 5""")
def _(t):
    return rounded(knn_edges(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 5))


@query("affinity_graph")
def _(t):
    return affinity_graph(embedding_columns(t), "vec_id", perplexity=30)


@query("fuzzy_graph")
def _(t):
    return fuzzy_graph(embedding_columns(t), "vec_id", n_neighbors=15)
