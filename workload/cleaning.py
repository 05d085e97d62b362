"""Type repair, imputation, outliers, deduplication, auto-clean and replayed steps."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators.clean import Deduplicate, FixTypes, NarrowTypes, SimpleImpute, dedupe
from millrace.operators.forest import IsolationForest
from millrace.operators.knn import KnnImpute
from millrace.operators.profile import table_of
from millrace.operators.scale import FillNumeric, InfinityToNull, IqrTreatment, Winsorize
from millrace.plans.autoclean import auto_clean
from millrace.plans.spec import FittedSteps, StepList
from workload.base import (CUSTOMERS_WITH_GAPS, ORDERS_WITH_GAPS, customers_with_gaps, orders_with_gaps, query,
                           rounded, union_sql)
from workload.profiles import TYPED_EVENTS, typed_events


@query("type_repair", f"""WITH {TYPED_EVENTS}, m AS (SELECT *, strftime(make_timestamp(1704067200000000 + event_id * 1000000),
  '%Y-%m-%d %H:%M:%S') AS moment_text FROM typed),
s AS (SELECT avg((TRY_CAST(value_text AS DOUBLE) IS NOT NULL)::INT) >= 0.9 AS v,
  avg((TRY_CAST(user_text AS DOUBLE) IS NOT NULL)::INT) >= 0.9 AS u FROM m)
SELECT event_id, CASE WHEN v THEN TRY_CAST(value_text AS DOUBLE) END AS value_text,
  CASE WHEN NOT u THEN user_text END AS user_text, event_type, moment_text::TIMESTAMP AS moment_text FROM m, s""")
def _(t):
    df = typed_events(t).withColumn("moment_text", F.expr(
        "date_format(timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id), 'yyyy-MM-dd HH:mm:ss')"))
    return FixTypes().fit_transform(df)


@query("narrow_types", """SELECT l_orderkey::INT AS l_orderkey, l_partkey::INT AS l_partkey, l_suppkey::INT AS l_suppkey,
  l_linenumber, l_quantity::FLOAT AS l_quantity, l_extendedprice::FLOAT AS l_extendedprice,
  l_discount::FLOAT AS l_discount, l_tax::FLOAT AS l_tax FROM lineitem""")
def _(t):
    return NarrowTypes().fit_transform(t("lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate"))


def simple_sql(fill: str) -> str:
    return f"""WITH {ORDERS_WITH_GAPS}, f AS (SELECT {fill} AS price FROM gaps),
    m AS (SELECT o_orderpriority AS priority FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus,
      round(coalesce(o_totalprice, price), 6) AS o_totalprice, o_orderdate, coalesce(o_orderpriority, priority) AS o_orderpriority
    FROM gaps, f, m"""


@query("simple_imputation_median", simple_sql("quantile_cont(o_totalprice, 0.5)"))
def _(t):
    return rounded(SimpleImpute(strategy="median").fit_transform(orders_with_gaps(t)))


@query("simple_imputation_mean", simple_sql("avg(o_totalprice)"))
def _(t):
    return rounded(SimpleImpute(strategy="mean").fit_transform(orders_with_gaps(t)))


@query("mean_fill", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, m), 6) AS o_totalprice
  FROM gaps, (SELECT avg(o_totalprice) AS m FROM gaps)""")
def _(t):
    df = orders_with_gaps(t).select("o_orderkey", "o_totalprice")
    return rounded(FillNumeric(exclude=["o_orderkey"]).fit_transform(df))


@query("median_fill", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, m), 6) AS o_totalprice
  FROM gaps, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM gaps)""")
def _(t):
    df = orders_with_gaps(t).select("o_orderkey", "o_totalprice")
    return rounded(FillNumeric(exclude=["o_orderkey"], method="median").fit_transform(df))


def knn_sql() -> str:
    """Brute force over all pairs of a gap and a donor."""
    gap = {c: f"(r.{c} - d.{c}) * (r.{c} - d.{c})" for c in "abc"}
    shared = " + ".join(f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in "abc")
    total = " + ".join(f"coalesce({gap[c]}, 0.0)" for c in "abc")
    fills = [f"""{c}f AS (SELECT a, avg(v) AS v FROM (SELECT r.a, d.{c} AS v, row_number() OVER (PARTITION BY r.a
      ORDER BY ({total}) * (3.0::DOUBLE / ({shared})), d.{c}) AS k FROM t r, t d WHERE r.{c} IS NULL AND d.{c} IS NOT NULL
      AND ({shared}) > 0) WHERE k <= 5 GROUP BY a)""" for c in "bc"]
    return f"""WITH {CUSTOMERS_WITH_GAPS}, t AS (SELECT c_custkey::DOUBLE AS a, c_nationkey::DOUBLE AS b, c_acctbal AS c FROM gaps),
    {', '.join(fills)}
    SELECT t.a AS c_custkey, 'Customer#' || lpad(t.a::BIGINT::VARCHAR, 9, '0') AS c_name, round(coalesce(t.b, bf.v), 6) AS c_nationkey,
      round(coalesce(t.c, cf.v), 6) AS c_acctbal FROM t LEFT JOIN bf ON t.a = bf.a LEFT JOIN cf ON t.a = cf.a"""


@query("knn_imputation", knn_sql())
def _(t):
    return rounded(KnnImpute().fit_transform(customers_with_gaps(t).drop("c_mktsegment")))


@query("isolation_forest")
def _(t):
    return IsolationForest(contamination=0.1).fit_transform(t("lineitem"))


@query("isolation_forest_flags")
def _(t):
    df = t("customer")
    forest = IsolationForest(columns=["c_nationkey", "c_acctbal"], contamination=0.05).fit(df)
    return IsolationForest.scored(df, forest.params)


@query("dedupe_rows", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def _(t):
    return Deduplicate().fit_transform(t("lineitem").select("l_partkey", "l_returnflag"))


@query("dedupe_first", """SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text
  ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def _(t):
    return dedupe(t("documents"), ["text"], "first", ["doc_id"]).drop("text")


@query("dedupe_last", """SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text
  ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1""")
def _(t):
    return dedupe(t("documents"), ["text"], "last", ["doc_id"]).drop("text")


@query("dedupe_drop_all", """SELECT doc_id, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS k
  FROM documents) WHERE k = 1""")
def _(t):
    return dedupe(t("documents"), ["text"], False).drop("text")


FENCE = "b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query("iqr_cap", f"""WITH {FENCE} SELECT event_id, event_type,
  round(greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 6) AS value FROM events, b""")
def _(t):
    return rounded(IqrTreatment(columns=["value"]).fit_transform(t("events").select("event_id", "event_type", "value")))


@query("iqr_remove", f"""WITH {FENCE} SELECT event_id, event_type, value FROM events, b
  WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(t):
    df = t("events").select("event_id", "event_type", "value")
    return IqrTreatment(columns=["value"], action="remove").fit_transform(df)


@query("winsorised", """WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(greatest(least(value, hi), lo), 6) AS value FROM events, b""")
def _(t):
    return rounded(Winsorize(columns=["value"]).fit_transform(t("events").select("event_id", "value")))


@query("winsorised_counts", """WITH b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi,
  quantile_cont(user_id::DOUBLE, 0.05) AS lo2, quantile_cont(user_id::DOUBLE, 0.95) AS hi2 FROM events)
SELECT 'value' AS "column", count_if(value < lo OR value > hi)::BIGINT AS clipped FROM events, b
UNION ALL SELECT 'user_id', count_if(user_id < lo2 OR user_id > hi2)::BIGINT FROM events, b""")
def _(t):
    df = t("events")
    fitted = Winsorize(columns=["value", "user_id"], lower=0.05, upper=0.95).fit(df)
    return table_of(df, list(Winsorize.changed(df, fitted.params).items()), "column string, clipped bigint")


@query("infinity_to_null", """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE value END AS value FROM events""")
def _(t):
    df = t("events").selectExpr("event_id", "case event_id % 10 when 0 then double('inf') when 1 then double('-inf') "
                                            "else value end as value")
    return InfinityToNull(columns=["value"]).fit_transform(df)


LINES = """SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END AS f, l_linestatus AS s FROM lineitem"""


@query("auto_clean", f"""WITH d AS ({LINES}),
m AS (SELECT (SELECT quantile_cont(q, 0.5) FROM d) AS q0,
  (SELECT f FROM d WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS f0),
i AS (SELECT coalesce(q, q0) AS q, coalesce(f, f0) AS f, s FROM d, m),
z AS (SELECT avg(q) AS a, stddev_pop(q) AS b FROM i)
SELECT round((q - a) / b, 6) + 0.0 AS q, s, f = 'A' AS f_A, f = 'N' AS f_N, f = 'R' AS f_R FROM i, z""")
def _(t):
    df = t("lineitem").selectExpr("case when l_linenumber % 3 = 0 then null else l_quantity end as q",
                                  "case when l_linenumber % 5 = 0 then null else l_returnflag end as f",
                                  "l_linestatus as s")
    return rounded(auto_clean(df).table)


@query("auto_clean_report", union_sql([f"SELECT {i + 1} AS step_no, '{s}' AS step" for i, s in enumerate(
    ["knn_imputation", "categorical_mode_imputation", "isolation_forest_outlier_removal", "frequency_encoding",
     "one_hot_encoding", "standardization"])]))
def _(t):
    df = customers_with_gaps(t).withColumn("c_tier", F.expr("case when c_custkey % 2 = 0 then 'even' else 'odd' end"))
    done = auto_clean(df)
    return table_of(df, [(i + 1, s) for i, s in enumerate(done.steps)], "step_no int, step string")


REPLAYED = [{"type": "mean_fill", "parameters": {"columns": ["o_totalprice"]}},
            {"type": "winsorization", "parameters": {"columns": ["o_totalprice"], "lower": 0.05, "upper": 0.95}},
            {"type": "standardization", "parameters": {"columns": ["o_totalprice"]}},
            {"type": "ordinal", "parameters": {"columns": ["o_orderstatus"]}}]


@query("steps_replayed", f"""WITH {ORDERS_WITH_GAPS},
m AS (SELECT avg(o_totalprice) AS m FROM gaps),
f AS (SELECT o_orderkey, o_orderstatus, coalesce(o_totalprice, m) AS p FROM gaps, m),
q AS (SELECT quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM f),
z AS (SELECT avg(greatest(least(p, hi), lo)) AS a, stddev_pop(greatest(least(p, hi), lo)) AS b FROM f, q)
SELECT o_orderkey, round((greatest(least(o_totalprice, hi), lo) - a) / b, 6) + 0.0 AS o_totalprice,
  (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus FROM orders, q, z""")
def _(t):
    """Fitted on the table with gaps, saved, loaded, and replayed on the table without."""
    learnt = StepList.from_json(StepList(REPLAYED, "prices").to_json()).fit(orders_with_gaps(t))
    replay = FittedSteps.from_json(learnt.to_json())
    return rounded(replay.transform(t("orders")).select("o_orderkey", "o_totalprice", "o_orderstatus"))


@query("steps_recorded", union_sql([
    f"SELECT {i + 1} AS step_no, '{s['type']}' AS type, '{json.dumps(s['parameters'], sort_keys=True)}' AS parameters, "
    "count(*) AS rows, 6 AS columns FROM orders" for i, s in enumerate(REPLAYED)]))
def _(t):
    df = orders_with_gaps(t)
    return StepList(REPLAYED).fit(df).history(df, datetime(2024, 1, 1)).drop("recorded_at")
