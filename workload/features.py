"""Scaling, encoding, binning, feature selection."""

from pyspark.sql import functions as F

from millrace.operators.encode import Binning, Frequency, OneHot, Ordinal, one_hot_long
from millrace.operators.scale import (LogPower, MinMax, QuantileTransform, RobustScale, SkewLog, Standardize)
from millrace.operators.select import CorrelationFilter, VarianceThreshold
from workload.base import ORDERS_WITH_GAPS, orders_with_gaps, query, rounded
from workload.profiles import WIDE_LINES, WIDE_NAMES, wide_lines


def prices(t):
    return orders_with_gaps(t).select("o_orderkey", "o_totalprice", "o_custkey")


KEY = {"exclude": ["o_orderkey"]}
FILLED = f"""WITH {ORDERS_WITH_GAPS}, p AS (SELECT o_orderkey, coalesce(o_totalprice, avg(o_totalprice) OVER ()) AS x,
  o_custkey::DOUBLE AS y FROM gaps)"""


@query("standardised", FILLED + """, s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p)
SELECT o_orderkey, round((x - mx) / sx, 6) + 0.0 AS o_totalprice, round((y - my) / sy, 6) + 0.0 AS o_custkey FROM p, s""")
def _(t):
    return rounded(Standardize(**KEY).fit_transform(prices(t)))


@query("min_max_scaled", FILLED + """, s AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT o_orderkey, round((x - lx) / (hx - lx) * 2 - 1, 6) + 0.0 AS o_totalprice, round((y - ly) / (hy - ly) * 2 - 1, 6) + 0.0 AS o_custkey
FROM p, s""")
def _(t):
    return rounded(MinMax(low=-1.0, high=1.0, **KEY).fit_transform(prices(t)))


def quartile(c, p):
    return f"quantile_cont({c}, {p})"


@query("robust_scaled", FILLED + f""", s AS (SELECT {quartile('x', .5)} AS mx, {quartile('x', .75)} - {quartile('x', .25)} AS sx,
  {quartile('y', .5)} AS my, {quartile('y', .75)} - {quartile('y', .25)} AS sy FROM p)
SELECT o_orderkey, round((x - mx) / sx, 6) + 0.0 AS o_totalprice, round((y - my) / sy, 6) + 0.0 AS o_custkey FROM p, s""")
def _(t):
    return rounded(RobustScale(**KEY).fit_transform(prices(t)))


QUANTILES = 100
GRID = "[" + ", ".join(str(i / (QUANTILES - 1)) for i in range(QUANTILES)) + "]"
# Both directions of interpolation agree where no two grid points tie.
UNIFORM = f"""WITH g AS (SELECT quantile_cont(value, {GRID}) AS q FROM events),
e AS (SELECT event_id, value, q, list_position(list_transform(q, lambda v: v > value), true) AS up FROM events, g)
SELECT event_id, round(CASE WHEN value <= q[1] THEN 0.0 WHEN value >= q[{QUANTILES}] THEN 1.0
  ELSE (up - 2 + (value - q[up - 1]) / (q[up] - q[up - 1])) / {QUANTILES - 1} END, 6) AS value FROM e"""


@query("quantile_uniform", UNIFORM)
def _(t):
    step = QuantileTransform(columns=["value"], n_quantiles=QUANTILES)
    return rounded(step.fit_transform(t("events").select("event_id", "value")))


@query("quantile_normal")
def _(t):
    step = QuantileTransform(exclude=["o_orderkey"], output_distribution="normal")
    return step.fit_transform(prices(t))


def log_query(name, method, sql):
    @query(name, FILLED + f"SELECT o_orderkey, round({sql.format('x')}, 6) AS o_totalprice, "
                          f"round({sql.format('y')}, 6) AS o_custkey FROM p")
    def _(t):
        return rounded(LogPower(method=method, power=0.5, **KEY).fit_transform(prices(t)))


log_query("log_scaled", "log", "ln(greatest({}, 1e-10))")
log_query("log10_scaled", "log10", "log10(greatest({}, 1e-10))")
log_query("log2_scaled", "log2", "log2(greatest({}, 1e-10))")
log_query("power_scaled", "power", "pow({}, 0.5)")


@query("skew_logged", """WITH s AS (SELECT skewness(value) AS g, min(value) AS lo FROM events)
SELECT event_id, round(CASE WHEN abs(g) >= 1.0 THEN ln(1 + CASE WHEN lo <= 0 THEN value - lo + 1 ELSE value END)
  ELSE value END, 6) AS value FROM events, s""")
def _(t):
    return rounded(SkewLog(columns=["value"]).fit_transform(t("events").select("event_id", "value")))


ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", f"WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, " + ", ".join(
    [f"(o_orderstatus = '{s}')::INT::DOUBLE AS \"o_orderstatus_{s}\"" for s in "FOP"]
    + [f"coalesce(o_orderpriority = '{p}', false)::INT::DOUBLE AS \"o_orderpriority_{p}\"" for p in ORDER_PRIORITIES]
    + ["(o_orderpriority IS NULL)::INT::DOUBLE AS \"o_orderpriority_None\""]) + " FROM gaps")
def _(t):
    return OneHot().fit_transform(orders_with_gaps(t).select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("one_hot_long", f"""WITH {ORDERS_WITH_GAPS} SELECT o_orderkey, 'o_orderstatus_' || o_orderstatus AS feature FROM gaps
  UNION ALL SELECT o_orderkey, 'o_orderpriority_' || coalesce(o_orderpriority, 'None') FROM gaps""")
def _(t):
    return one_hot_long(orders_with_gaps(t), ["o_orderkey"])


@query("ordinal", f"""WITH {ORDERS_WITH_GAPS}, c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k
  FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus, k::DOUBLE AS o_orderpriority
FROM gaps LEFT JOIN c ON o_orderpriority = v""")
def _(t):
    return Ordinal().fit_transform(orders_with_gaps(t).select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("frequency_encoded", f"""WITH {ORDERS_WITH_GAPS}
SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderstatus)::DOUBLE / count(*) OVER (), 6) AS o_orderstatus,
  round(count(*) OVER (PARTITION BY o_orderpriority)::DOUBLE / count(*) OVER (), 6) AS o_orderpriority FROM gaps""")
def _(t):
    df = orders_with_gaps(t).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rounded(Frequency().fit_transform(df))


BINNED = {"columns": ["value"], "n_bins": 5}
EDGE_HITS = " + ".join(f"(value >= {{}}[{i}])::INT" for i in range(2, 6))


@query("bins_quantile", "WITH e AS (SELECT quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM events) "
       f"SELECT event_id, ({EDGE_HITS.replace('{}', 'q')})::DOUBLE AS value FROM events, e")
def _(t):
    return Binning(**BINNED).fit_transform(t("events").select("event_id", "value"))


@query("bins_uniform", "WITH e AS (SELECT list_transform([0, 1, 2, 3, 4, 5], lambda i: lo + (hi - lo) * i / 5) AS q FROM "
       "(SELECT min(value) AS lo, max(value) AS hi FROM events)) "
       f"SELECT event_id, ({EDGE_HITS.replace('{}', 'q')})::DOUBLE AS value FROM events, e")
def _(t):
    return Binning(strategy="uniform", **BINNED).fit_transform(t("events").select("event_id", "value"))


@query("bins_kmeans")
def _(t):
    return Binning(strategy="kmeans", **BINNED).fit_transform(t("events").select("event_id", "value"))


@query("correlation_filter", "SELECT round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, "
       "round(l_tax, 6) AS l_tax FROM lineitem")
def _(t):
    return rounded(CorrelationFilter().fit_transform(wide_lines(t)))


@query("correlation_removed", f"WITH {WIDE_LINES}\nSELECT DISTINCT b AS removed FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS b, abs(corr({a}, {b})) AS r FROM wide"
    for i, a in enumerate(WIDE_NAMES) for b in WIDE_NAMES[i + 1:]) + ") WHERE r > 0.95")
def _(t):
    df = wide_lines(t)
    gone = CorrelationFilter().fit(df).params["drop"]
    return df.sparkSession.createDataFrame([(c,) for c in gone], "removed string")


@query("variance_threshold", """SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
  WHERE (SELECT var_pop(l_discount) FROM lineitem) <= 0.01 AND (SELECT var_pop(l_quantity) FROM lineitem) > 0.01""")
def _(t):
    df = t("lineitem").select("l_quantity", "l_returnflag", "l_extendedprice", "l_discount", F.lit(1).alias("one"))
    return VarianceThreshold(threshold=0.01).fit_transform(df)
