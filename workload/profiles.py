"""Profiles, health, quality and reports."""

from pyspark.sql import functions as F

from millrace.operators import compare, profile as P
from millrace.operators.scale import IqrTreatment
from millrace.plans import health as H
from millrace.plans.report import preview, report_bundle
from millrace.runtime import scratch_path
from workload.base import (CUSTOMERS_WITH_GAPS, LINEITEM_NUMERIC, ORDERS_WITH_GAPS, customers_with_gaps,
                           orders_with_gaps, query, rounded, union_sql)


def stats_sql(source: str, columns: list[str]) -> str:
    return union_sql([f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean,
      round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std,
      round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
      round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75
      FROM {source}""" for c in columns])


@query("numeric_statistics", stats_sql("lineitem", LINEITEM_NUMERIC))
def _(t):
    return rounded(P.numeric_statistics(t("lineitem")))


@query("percentile_list", union_sql([
    f"SELECT '{c}' AS \"column\", 'p{p}' AS percentile, round(quantile_cont({c}::DOUBLE, {p / 100}), 6) AS value FROM orders"
    for c in ("o_totalprice", "o_custkey") for p in (0, 10, 25, 50, 75, 90, 100)]))
def _(t):
    return rounded(P.percentile_list(t("orders"), ["o_totalprice", "o_custkey"], [0, 10, 25, 50, 75, 90, 100]))


@query("null_counts", f"WITH {ORDERS_WITH_GAPS}\n" + union_sql([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM gaps"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]))
def _(t):
    return P.null_counts(orders_with_gaps(t))


@query("duplicate_rows", """
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates,
  round(sum(n - 1)::DOUBLE / sum(n) * 100, 6) AS duplicate_pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def _(t):
    return rounded(P.duplicate_rows(t("lineitem").select("l_orderkey", "l_linenumber")))


@query("distinct_counts", f"WITH {ORDERS_WITH_GAPS}\n" + union_sql([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM gaps"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]))
def _(t):
    return P.distinct_counts(orders_with_gaps(t))


@query("top_values", union_sql([f"""SELECT * FROM (SELECT '{c}' AS "column",
    (row_number() OVER (ORDER BY count(*) DESC, {c}))::INT AS rank, {c} AS value, count(*) AS count
    FROM part GROUP BY {c}) WHERE rank <= 10""" for c in ("p_name", "p_brand", "p_type")]))
def _(t):
    return P.top_values(t("part"))


@query("modes", f"WITH {ORDERS_WITH_GAPS}\n" + union_sql([f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS mode,
    count(*) AS count FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} LIMIT 1)"""
    for c in ("o_orderstatus", "o_orderpriority")]))
def _(t):
    return P.modes(orders_with_gaps(t))


@query("correlation_matrix", union_sql([
    f"SELECT '{a}' AS row_col, '{b}' AS col_col, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0 AS value FROM lineitem"
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC]))
def _(t):
    return rounded(P.correlation_matrix(t("lineitem")))


WIDE_LINES = """wide AS (SELECT l_quantity, l_extendedprice, l_quantity * 2 + 1 AS double_quantity,
  l_extendedprice * (1 - l_discount) AS revenue, l_tax FROM lineitem)"""


def wide_lines(t):
    return t("lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + 1).alias("double_quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), "l_tax")


WIDE_NAMES = ["l_quantity", "l_extendedprice", "double_quantity", "revenue", "l_tax"]


@query("correlated_pairs", f"WITH {WIDE_LINES}\nSELECT * FROM (" + union_sql([
    f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS correlation FROM wide"
    for i, a in enumerate(WIDE_NAMES) for b in WIDE_NAMES[i + 1:]]) + ") WHERE abs(correlation) >= 0.9")
def _(t):
    return rounded(P.correlated_pairs(wide_lines(t)))


@query("skewed_columns", "SELECT * FROM (" + union_sql([
    f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) + 0.0 AS skew FROM events"
    for c in ("event_id", "user_id", "value")]) + ") WHERE abs(skew) >= 1.0")
def _(t):
    return rounded(P.skewed_columns(t("events")))


def fences(source: str, columns: list[str], factor: float = 1.5) -> str:
    parts = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS a_{c}, quantile_cont({c}::DOUBLE, 0.75) AS b_{c}"
                      for c in columns)
    return f"fence AS (SELECT {parts} FROM {source})"


def flag(c: str, skip_flat: bool, factor: float = 1.5) -> str:
    hit = f"({c} < a_{c} - {factor} * (b_{c} - a_{c}) OR {c} > b_{c} + {factor} * (b_{c} - a_{c}))"
    return f"coalesce({hit}" + (f" AND b_{c} <> a_{c}" if skip_flat else "") + ", false)"


EVENTS = ["event_id", "user_id", "value"]


@query("outlier_report", f"WITH {fences('events', EVENTS)}\n" + union_sql([
    f"SELECT '{c}' AS \"column\", count_if({flag(c, True)})::BIGINT AS outliers FROM events, fence" for c in EVENTS]
    + [f"SELECT '(any)' AS \"column\", count_if({' OR '.join(flag(c, True) for c in EVENTS)})::BIGINT AS outliers "
       "FROM events, fence"]))
def _(t):
    return P.outlier_report(t("events"))


# More than half of the discounts become one value, so that the quartiles coincide.
FLAT = """flat AS (SELECT l_quantity, CASE WHEN l_linenumber <= 6 THEN 0.05 ELSE l_discount END AS l_discount
  FROM lineitem)"""


@query("outlier_counts_plain", f"WITH {FLAT}, {fences('flat', ['l_quantity', 'l_discount'])}\n" + union_sql([
    f"SELECT '{c}' AS \"column\", count_if({flag(c, False)})::BIGINT AS outliers FROM flat, fence"
    for c in ("l_quantity", "l_discount")]))
def _(t):
    return P.outlier_counts_plain(t("lineitem").selectExpr(
        "l_quantity", "case when l_linenumber <= 6 then 0.05D else l_discount end as l_discount"))


@query("target_column", """
SELECT CASE WHEN (SELECT count(DISTINCT c_mktsegment) FROM customer) BETWEEN 2 AND 20 THEN 'c_mktsegment'
  WHEN (SELECT count(DISTINCT c_name) FROM customer) BETWEEN 2 AND 20 THEN 'c_name' END AS target""")
def _(t):
    df = t("customer")
    return P.table_of(df, [(P.find_target(df),)], "target string")


@query("class_imbalance", f"""WITH {ORDERS_WITH_GAPS},
sizes AS (SELECT o_orderpriority AS label, count(*) AS n FROM gaps GROUP BY 1)
SELECT 'o_orderpriority' AS label_column, label, n AS count,
  round(max(n) OVER ()::DOUBLE / min(n) OVER (), 3) AS ratio,
  max(n) OVER ()::DOUBLE / min(n) OVER () >= 3.0 AS imbalanced FROM sizes""")
def _(t):
    return P.class_imbalance(orders_with_gaps(t))


TYPED_EVENTS = """typed AS (SELECT event_id,
  CASE WHEN event_id % 20 = 0 THEN 'unknown' ELSE value::VARCHAR END AS value_text,
  CASE WHEN event_id % 8 = 0 THEN event_type ELSE user_id::VARCHAR END AS user_text, event_type FROM events)"""


def typed_events(t):
    return t("events").selectExpr(
        "event_id", "case when event_id % 20 = 0 then 'unknown' else cast(value as string) end as value_text",
        "case when event_id % 8 = 0 then event_type else cast(user_id as string) end as user_text", "event_type")


@query("type_inconsistency", f"WITH {TYPED_EVENTS}\nSELECT * FROM (" + union_sql([
    f"SELECT '{c}' AS \"column\", round(avg((TRY_CAST({c} AS DOUBLE) IS NOT NULL)::INT), 6) AS numeric_share FROM typed"
    for c in ("value_text", "user_text", "event_type")]) + ") WHERE numeric_share >= 0.85")
def _(t):
    return rounded(P.type_inconsistencies(typed_events(t)))


@query("scale_spread", "WITH s AS (SELECT " + ", ".join(f"stddev_samp({c}) AS {c}" for c in LINEITEM_NUMERIC) + f"""
  FROM lineitem) SELECT round(greatest({', '.join(LINEITEM_NUMERIC)}) / least({', '.join(LINEITEM_NUMERIC)}), 3)
  AS spread, greatest({', '.join(LINEITEM_NUMERIC)}) / least({', '.join(LINEITEM_NUMERIC)}) >= 10.0 AS normalise FROM s""")
def _(t):
    df = t("lineitem")
    spread = P.scale_spread(P.base_facts(df))
    return rounded(P.table_of(df, [(spread, spread >= 10.0)], "spread double, normalise boolean"), 3)


def histogram_sql(source: str, columns: list[str], bins: int = 30) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS "column", bin::INT AS bin, round(lo + bin * w, 6) AS low,
          round(lo + (bin + 1) * w, 6) AS high, count(*) AS count FROM (
            SELECT lo, (hi - lo) / {bins} AS w, least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bin
            FROM {source}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {source}) WHERE {c} IS NOT NULL)
          GROUP BY bin, lo, w""")
    return union_sql(parts)


@query("histogram", histogram_sql("events", EVENTS))
def _(t):
    return rounded(P.histogram(t("events")))


@query("reciprocal_histogram", "WITH r AS (SELECT 1.0 / nullif(value, 0) AS value FROM events)\n"
       + histogram_sql("r", ["value"]))
def _(t):
    return rounded(P.histogram(P.reciprocal_of(t("events").select("value"))))


@query("squared_histogram", "WITH r AS (SELECT value * value AS value FROM events)\n" + histogram_sql("r", ["value"]))
def _(t):
    return rounded(P.histogram(P.squared_of(t("events").select("value"))))


@query("box_summary", f"WITH {fences('events', EVENTS)}\n" + union_sql([f"""SELECT '{c}' AS "column",
    round(min({c})::DOUBLE, 6) AS min, round(any_value(a_{c}), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
    round(any_value(b_{c}), 6) AS q75, round(max({c})::DOUBLE, 6) AS max,
    round(any_value(a_{c} - 1.5 * (b_{c} - a_{c})), 6) AS lower_fence,
    round(any_value(b_{c} + 1.5 * (b_{c} - a_{c})), 6) AS upper_fence,
    count_if({flag(c, False)})::BIGINT AS outliers FROM events, fence""" for c in EVENTS]))
def _(t):
    return rounded(P.box_summary(t("events")))


# ---------------------------------------------------------------- health

class HealthSql:
    """SQL of the report's facts for one table."""

    def __init__(self, ctes: str, source: str, columns, numeric, categorical, strings, target):
        self.columns, self.numeric, self.categorical, self.target = columns, numeric, categorical, target
        facts = ["count(*) AS n"]
        facts += [f"count(*) - count({c}) AS miss_{c}" for c in columns]
        for c in numeric:
            facts += [f"quantile_cont({c}::DOUBLE, 0.25) AS a_{c}", f"quantile_cont({c}::DOUBLE, 0.75) AS b_{c}",
                      f"skewness({c}) AS skew_{c}", f"stddev_samp({c}) AS std_{c}", f"min({c}) AS min_{c}"]
        facts += [f"count(DISTINCT {c}) AS dist_{c}" for c in categorical]
        facts += [f"avg((TRY_CAST({c} AS DOUBLE) IS NOT NULL)::INT) FILTER (WHERE {c} IS NOT NULL) AS num_{c}"
                  for c in strings]
        self.pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
        facts += [f"corr({a}::DOUBLE, {b}::DOUBLE) AS corr_{a}_{b}" for a, b in self.pairs]
        any_flag = " OR ".join(flag(c, True) for c in numeric)
        outl = ", ".join(f"count_if({flag(c, True)}) AS out_{c}" for c in numeric)
        total = " + ".join(f"miss_{c}" for c in columns)
        skewed = " + ".join(f"(abs(coalesce(skew_{c}, 0)) >= 1.0)::INT" for c in numeric)
        positive = " + ".join(f"(abs(coalesce(skew_{c}, 0)) >= 1.0 AND min_{c} > 0)::INT" for c in numeric)
        high = " + ".join(f"(dist_{c} > 20)::INT" for c in categorical)
        inconsistent = " + ".join(f"(num_{c} >= 0.85)::INT" for c in strings)
        pairs = " + ".join(["0"] + [f"(abs(coalesce(corr_{a}_{b}, 0)) >= 0.9)::INT" for a, b in self.pairs])
        stds = ", ".join(f"nullif(std_{c}, 0)" for c in numeric)
        self.ctes = f"""WITH {ctes + ', ' if ctes else ''}fence AS (SELECT {', '.join(facts)} FROM {source}),
        outl AS (SELECT {outl}, count_if({any_flag}) AS outlier_rows FROM {source}, fence),
        dup AS (SELECT (SELECT count(*) FROM {source}) - count(*) AS duplicates FROM (SELECT DISTINCT * FROM {source})),
        cls AS (SELECT max(k)::DOUBLE / min(k) AS ratio0 FROM (SELECT count(*) AS k FROM {source} GROUP BY {target})),
        h AS (SELECT *, {total} AS missing, {' + '.join(f'miss_{c}' for c in numeric)} AS miss_numeric,
          {' + '.join(f'miss_{c}' for c in categorical)} AS miss_cat, {skewed} AS skewed, {positive} AS positive,
          {high} AS high, {len(categorical)} - ({high}) AS low, {inconsistent} AS inconsistent, {pairs} AS pairs,
          greatest({stds}) / least({stds}) AS spread, round(ratio0, 3) AS ratio, {len(numeric)} AS n_numeric,
          {len(categorical)} AS n_cat, {len(columns)} AS n_cols FROM fence, outl, dup, cls)"""

    def report(self):
        facts = {"rows": "n", "columns": "n_cols", "missing_values": "missing", "duplicates": "duplicates",
                 "outlier_rows": "outlier_rows", "numeric_columns": "n_numeric", "categorical_columns": "n_cat",
                 "correlated_pairs": "pairs", "skewed_columns": "skewed", "inconsistent_columns": "inconsistent",
                 "imbalance_ratio": "ratio"}
        parts = [("*", m, e) for m, e in facts.items()]
        for c in self.columns:
            parts.append((c, "missing", f"miss_{c}"))
            if c in self.numeric:
                parts += [(c, "outliers", f"out_{c}"), (c, "skew", f"skew_{c}")]
            if c in self.categorical:
                parts.append((c, "distinct", f"dist_{c}"))
        return self.ctes + "\n" + union_sql([
            f"SELECT '{c}' AS \"column\", '{m}' AS metric, round(({e})::DOUBLE, 6) + 0.0 AS value FROM h" for c, m, e in parts])

    def score(self):
        return self.ctes + """, p AS (SELECT least(25.0, 100.0 * missing / (n * n_cols)) AS a,
          least(15.0, 100.0 * duplicates / n) AS b, least(20.0, 100.0 * outlier_rows / n) AS c,
          least(10.0, 100.0 * skewed / n_cols) AS d, least(15.0, 100.0 * inconsistent / n_cols) AS e,
          CASE WHEN ratio0 >= 3.0 THEN least(15.0, 3.0 * (ratio - 1)) ELSE 0.0 END AS f FROM h)
        SELECT round(greatest(0.0, least(100.0, 100.0 - a - b - c - d - e - f))::DOUBLE, 2) AS score,
          round(a::DOUBLE, 2) AS missing_values_penalty, round(b::DOUBLE, 2) AS duplicate_rows_penalty,
          round(c::DOUBLE, 2) AS outliers_penalty, round(d::DOUBLE, 2) AS skewness_penalty,
          round(e::DOUBLE, 2) AS type_inconsistency_penalty, round(f::DOUBLE, 2) AS imbalance_penalty FROM p"""

    def snapshot(self):
        return f"""SELECT s.score, ((duplicates > 0)::INT + (missing > 0)::INT + (outlier_rows > 0)::INT
          + (skewed > 0)::INT + (n_cat > 0)::INT + (inconsistent > 0)::INT + (ratio0 >= 3.0)::INT)::BIGINT AS issues_count,
          duplicates::BIGINT AS duplicates, missing::BIGINT AS missing_total, outlier_rows::BIGINT AS outlier_rows
          FROM ({self.ctes} SELECT * FROM h) h, ({self.score()}) s"""

    def fixes(self):
        rules = [
            ("duplicates > 0", "'remove_duplicates'", "duplicates || ' duplicate rows detected'",
             "CASE WHEN duplicates >= 0.01 * n THEN 'high' ELSE 'medium' END"),
            ("miss_numeric > 0", "CASE WHEN n_numeric >= 2 AND n >= 30 THEN 'knn_imputation' "
             "ELSE 'simple_numeric_imputation' END", "miss_numeric || ' missing numeric values detected'",
             "CASE WHEN n_numeric >= 2 AND n >= 30 THEN 'high' ELSE 'medium' END"),
            ("miss_cat > 0", "'categorical_mode_imputation'", "miss_cat || ' missing categorical values detected'", "'high'"),
            ("outlier_rows > 0 AND n_numeric >= 3 AND n >= 100 AND outlier_rows >= 0.02 * n",
             "'isolation_forest_outlier_removal'",
             "outlier_rows || ' outlier rows (' || printf('%.1f', 100.0 * outlier_rows / n) || '%) detected in numeric features'",
             "'medium'"),
            ("outlier_rows > 0 AND NOT (n_numeric >= 3 AND n >= 100 AND outlier_rows >= 0.02 * n)",
             "'iqr_outlier_treatment'",
             "outlier_rows || ' potential outlier rows detected; conservative capping is safer'", "'medium'"),
            ("skewed > 0 AND positive > 0", "'log_transform'", "positive || ' skewed positive numeric columns found'", "'medium'"),
            ("skewed > 0 AND positive = 0", "'power_transform'",
             "'Skewed numeric columns include non-positive values'", "'low'"),
            ("low > 0", "'one_hot_encoding'", "low || ' low-cardinality categorical columns'", "'high'"),
            ("high > 0", "'frequency_encoding'", "high || ' high-cardinality categorical columns'", "'high'"),
            ("inconsistent > 0", "'fix_column_types'",
             "inconsistent || ' columns look numeric/datetime but are stored as text'", "'medium'"),
            ("ratio0 >= 3.0", "'class_weight_or_resampling'", "'Imbalance ratio is ' || ratio", "'medium'"),
            ("spread >= 10", "'normalize_numeric_features'",
             "'Numeric feature scale spread ratio is ' || printf('%.2f', spread)", "'medium'")]
        rows = union_sql([f"SELECT {i} AS k, {f} AS fix, {r} AS reason, {c} AS confidence FROM h WHERE {w}"
                          for i, (w, f, r, c) in enumerate(rules)])
        return self.ctes + f"""\nSELECT (row_number() OVER (ORDER BY k))::INT AS position, fix, reason, confidence
          FROM ({rows})"""

    def steps(self):
        rules = [("duplicates > 0", "remove_duplicates"), ("missing > 0 AND n_numeric >= 2", "knn_imputation"),
                 ("missing > 0 AND n_numeric < 2", "simple_imputation"), ("inconsistent > 0", "fix_column_types"),
                 ("high > 0", "frequency_encoding"), ("high < n_cat", "one_hot_encoding"), ("skewed > 0", "log_transform"),
                 ("outlier_rows > 0", "isolation_forest_outlier_removal"), ("n_numeric > 0", "standardization"),
                 ("n_cols >= 50 OR n_numeric >= 20", "pca")]
        rows = union_sql([f"SELECT {i} AS k, '{s}' AS step, '{H.REASONS[s]}' AS reason, n FROM h WHERE {w}"
                          for i, (w, s) in enumerate(rules)])
        return self.ctes + f"""\nSELECT (row_number() OVER (ORDER BY k))::INT AS step_no, step, reason,
          round(least(0.98, 0.60 + 0.05 * count(*) OVER () + CASE WHEN n > 1000 THEN 0.05 ELSE 0 END)::DOUBLE, 2)
          AS confidence FROM ({rows})"""


ORDERS_HEALTH = HealthSql(
    ORDERS_WITH_GAPS, "gaps", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"],
    ["o_orderstatus", "o_orderpriority"], "o_orderpriority")

EVENT_VALUES = """ev AS (SELECT event_type, value, value_text FROM (SELECT event_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, (event_id % 97)::VARCHAR AS value_text FROM events))"""
EVENTS_HEALTH = HealthSql(EVENT_VALUES, "ev", ["event_type", "value", "value_text"], ["value"],
                          ["event_type", "value_text"], ["event_type", "value_text"], "event_type")


def event_values(t):
    return t("events").selectExpr("event_type", "case when event_id % 5 = 0 then null else value end as value",
                                  "cast(event_id % 97 as string) as value_text")


@query("health_report", ORDERS_HEALTH.report())
def _(t):
    return rounded(H.health_table(orders_with_gaps(t)))


@query("quality_score", ORDERS_HEALTH.score())
def _(t):
    return H.quality_table(orders_with_gaps(t))


@query("quality_snapshot", ORDERS_HEALTH.snapshot())
def _(t):
    return H.quality_snapshot(orders_with_gaps(t))


@query("suggested_fixes", ORDERS_HEALTH.fixes())
def _(t):
    return H.fixes_table(orders_with_gaps(t))


@query("suggested_steps", ORDERS_HEALTH.steps())
def _(t):
    return H.suggested_steps(orders_with_gaps(t))


# A table with copies, skew, outliers and numbers kept as text.
@query("health_report_events", EVENTS_HEALTH.report())
def _(t):
    return rounded(H.health_table(event_values(t)))


@query("quality_score_events", EVENTS_HEALTH.score())
def _(t):
    return H.quality_table(event_values(t))


@query("suggested_fixes_events", EVENTS_HEALTH.fixes())
def _(t):
    return H.fixes_table(event_values(t))


@query("suggested_steps_events", EVENTS_HEALTH.steps())
def _(t):
    return H.suggested_steps(event_values(t))


# ---------------------------------------------------------------- comparison, preview, report

BOUNDS = "b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM gaps)"
KEPT = """kept AS (SELECT gaps.* FROM gaps, b WHERE NOT coalesce(o_totalprice < q1 - 1.0 * (q3 - q1)
  OR o_totalprice > q3 + 1.0 * (q3 - q1), false))"""
MISSING = "sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT)::BIGINT"


@query("before_after", f"""WITH {ORDERS_WITH_GAPS}, {BOUNDS}, {KEPT},
f AS (SELECT (SELECT count(*) FROM gaps) AS r0, (SELECT count(*) FROM kept) AS r1,
  (SELECT {MISSING} FROM gaps) AS m0, (SELECT {MISSING} FROM kept) AS m1,
  (SELECT count(*) FROM gaps) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) AS d0,
  (SELECT count(*) FROM kept) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS d1)
SELECT 'rows' AS metric, r0 AS before, r1 AS after, r1 - r0 AS change FROM f
UNION ALL SELECT 'columns', 6::BIGINT, 6::BIGINT, 0::BIGINT FROM f
UNION ALL SELECT 'missing_values', m0, m1, m0 - m1 FROM f
UNION ALL SELECT 'duplicates', d0, d1, d0 - d1 FROM f""")
def _(t):
    before = orders_with_gaps(t)
    treat = IqrTreatment(columns=["o_totalprice"], factor=1.0, action="remove")
    return compare.before_after(before, treat.fit_transform(before))


@query("column_changes", """SELECT * FROM (VALUES ('c_custkey', true, true), ('c_name', true, true),
  ('c_nationkey', true, false), ('c_acctbal', true, true), ('c_mktsegment', true, true), ('segment', false, true))
  v("column", in_before, in_after)""")
def _(t):
    before = t("customer")
    return compare.column_changes(before, before.drop("c_nationkey").withColumn("segment", F.col("c_mktsegment")))


@query("side_by_side", f"""WITH {ORDERS_WITH_GAPS}, {BOUNDS}
SELECT * FROM (SELECT 'before' AS side, o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice
  FROM gaps ORDER BY o_orderkey LIMIT 1000)
UNION ALL SELECT * FROM (SELECT 'after', o_orderkey, o_custkey::DOUBLE, round(CASE WHEN o_totalprice IS NOT NULL THEN
  greatest(least(o_totalprice, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)) END, 6) FROM gaps, b ORDER BY o_orderkey LIMIT 1000)""")
def _(t):
    before = orders_with_gaps(t)
    treat = IqrTreatment(columns=["o_totalprice"], factor=0.5)
    return rounded(compare.side_by_side(before, treat.fit_transform(before), ["o_orderkey"], 1000))


@query("preview_rows", "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in (
    "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    + f" FROM (WITH {CUSTOMERS_WITH_GAPS} SELECT * FROM gaps ORDER BY c_custkey LIMIT 5)")
def _(t):
    return preview(customers_with_gaps(t), ["c_custkey"])["rows"]


@query("preview_columns", f"WITH {CUSTOMERS_WITH_GAPS}\n" + union_sql([
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", '{k}' AS type, count(*) - count({c}) AS null_count FROM gaps"
    for i, (c, k) in enumerate([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                                ("c_acctbal", "double"), ("c_mktsegment", "string")])]))
def _(t):
    return preview(customers_with_gaps(t), ["c_custkey"])["columns"]


@query("report_bundle")
def _(t):
    df = orders_with_gaps(t)
    paths = report_bundle(df, scratch_path(df.sparkSession, "report"), "orders", before=t("orders"))
    parts = [df.sparkSession.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
             for n, p in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
