"""Projections, filters, sorts, paging, set operations and scalar functions."""

from pyspark.sql import functions as F

from millrace.functions.arrays import argmax, top_positions
from millrace.functions.casts import to_moment, to_number
from millrace.functions.numbers import clip, log1p_shifted
from millrace.functions.text import clean_text, space_tokens, text_stats, truncate_text, word_tokens
from millrace.operators import select as R
from millrace.operators.profile import base_facts
from millrace.plans.spec import map_batches
from millrace.schema import text_columns
from workload.base import (CUSTOMERS_WITH_GAPS, ORDERS_WITH_GAPS, customers_with_gaps, orders_with_gaps, query,
                           rounded)


@query("columns_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return R.by_class(t("orders"), "numeric")


@query("columns_categorical", "SELECT o_orderstatus, o_orderpriority, big FROM (SELECT *, o_totalprice > 1000 AS big FROM orders)")
def _(t):
    return R.by_class(t("orders").withColumn("big", F.expr("o_totalprice > 1000")), "cat_profile")


@query("columns_encoded", "SELECT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return R.by_class(t("orders"), "cat_encode")


@query("columns_imputed", "SELECT o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def _(t):
    return R.by_class(t("orders"), "cat_impute")


@query("columns_text", """SELECT "column" FROM (SELECT 'text' AS "column", avg(length(text)) AS n FROM documents
  UNION ALL SELECT 'lang', avg(length(lang)) FROM documents UNION ALL SELECT 'source', avg(length(source)) FROM documents)
  WHERE n >= 10""")
def _(t):
    df = t("documents")
    return df.sparkSession.createDataFrame([(c,) for c in text_columns(df)], "column string")


@query("visible_columns", "SELECT c_name, c_acctbal FROM customer")
def _(t):
    return t("customer").select("c_name", "c_acctbal")


@query("dropped_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    return t("customer").drop("c_name", "c_mktsegment")


@query("search_any_column", """SELECT * FROM orders WHERE contains(lower(o_orderkey::VARCHAR), 'urgent')
  OR contains(lower(o_custkey::VARCHAR), 'urgent') OR contains(lower(o_orderstatus), 'urgent')
  OR contains(lower(o_orderpriority), 'urgent')""")
def _(t):
    return R.search_rows(t("orders"), "Urgent")


@query("search_any_column_regex", """SELECT * FROM customer WHERE regexp_matches(c_custkey::VARCHAR, '(?i)(^7+$|^auto)')
  OR regexp_matches(c_name, '(?i)(^7+$|^auto)') OR regexp_matches(c_nationkey::VARCHAR, '(?i)(^7+$|^auto)')
  OR regexp_matches(c_mktsegment, '(?i)(^7+$|^auto)')""")
def _(t):
    return R.search_rows(t("customer"), "(^7+$|^auto)", regex=True)


@query("incomplete_rows", f"""WITH {CUSTOMERS_WITH_GAPS}, e AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN ''
  ELSE c_name END AS c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM gaps)
SELECT * FROM e WHERE c_nationkey IS NULL OR c_acctbal IS NULL OR c_name = ''""")
def _(t):
    df = customers_with_gaps(t).withColumn("c_name", F.expr("case when c_custkey % 13 = 0 then '' else c_name end"))
    df = df.withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return R.incomplete_rows(df)


@query("complete_rows", f"WITH {ORDERS_WITH_GAPS} SELECT * FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def _(t):
    return R.complete_rows(orders_with_gaps(t))


@query("masked_rows", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(t):
    return t("lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))


@query("structure_warnings", f"""WITH {ORDERS_WITH_GAPS}
SELECT count(*) > 0 AS valid, count(*) AS rows, sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT)::BIGINT
  AS null_cells, CASE WHEN sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) > 0.5 * count(*)
  THEN 'More than 50% missing values' ELSE '' END AS warnings FROM gaps""")
def _(t):
    return R.structure_warnings(orders_with_gaps(t))


@query("sorted_nulls_last", f"WITH {ORDERS_WITH_GAPS} SELECT * FROM gaps ORDER BY o_totalprice DESC NULLS LAST")
def _(t):
    return R.sort_rows(orders_with_gaps(t), "o_totalprice", ascending=False)


@query("first_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return R.head(t("orders"), ["o_orderkey"], 5)


@query("most_frequent_parts", """SELECT l_partkey, count(*) AS lines FROM lineitem GROUP BY l_partkey
  ORDER BY lines DESC, l_partkey LIMIT 10""")
def _(t):
    counts = t("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    return counts.orderBy(F.desc("lines"), "l_partkey").limit(10)


@query("paged_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return R.page(t("orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 100)


@query("concatenated_rows", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def _(t):
    buyers = t("customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance")
    return buyers.unionByName(t("supplier").selectExpr("s_name as name", "s_suppkey as key", "s_acctbal as balance"))


@query("distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber").distinct()


SPACE_SQL = r"\s\x0B\x{1C}-\x{1F}\x{85}\pZ"


@query("text_statistics", rf"""SELECT doc_id, length(text)::INT AS length, len(words)::INT AS word_count,
  round(CASE WHEN len(words) > 0 THEN length(text)::DOUBLE / len(words) ELSE 0.0 END, 6) AS avg_word_length,
  len(list_distinct(list_transform(words, lambda w: lower(w))))::INT AS unique_words,
  regexp_matches(text, '[\p{{Nd}}\x{{B2}}\x{{B3}}\x{{B9}}\x{{2070}}\x{{2074}}-\x{{2079}}\x{{2080}}-\x{{2089}}\x{{2460}}-\x{{2468}}]') AS has_numbers,
  regexp_matches(text, '[^\p{{L}}\p{{N}}{SPACE_SQL}]') AS has_special
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[{SPACE_SQL}]+'), lambda w: w <> '') AS words FROM documents)""")
def _(t):
    return rounded(t("documents").select("doc_id", *[c.alias(n) for n, c in text_stats(F.col("text")).items()]))


@query("truncated_text", """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS text
  FROM documents""")
def _(t):
    return t("documents").select("doc_id", truncate_text(F.col("text")).alias("text"))


@query("cleaned_text", rf"""SELECT doc_id, trim(regexp_replace(lower(text), '[{SPACE_SQL}]+', ' ', 'g')) AS text FROM documents
  UNION ALL SELECT conv_id, trim(regexp_replace(lower(text), '[{SPACE_SQL}]+', ' ', 'g')) FROM conversations""")
def _(t):
    docs = t("documents").select("doc_id", clean_text(F.col("text")).alias("text"))
    return docs.unionByName(t("conversations").select(F.col("conv_id").alias("doc_id"), clean_text(F.col("text")).alias("text")))


@query("clipped_and_shifted", """SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS clipped,
  greatest(c_acctbal, 0.0) AS floored,
  round(ln(1 + CASE WHEN lo <= 0 THEN c_acctbal - lo + 1 ELSE c_acctbal END), 6) AS logged
FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)""")
def _(t):
    df = t("customer")
    lowest = base_facts(df, ["c_acctbal"])["c_acctbal"]["min"]
    x = F.col("c_acctbal")
    return rounded(df.select("c_custkey", clip(x, 0.0, 5000.0).alias("clipped"), clip(x, low=0.0).alias("floored"),
                             log1p_shifted(x, lowest).alias("logged")))


@query("lenient_parse", """SELECT event_id, TRY_CAST(raw AS DOUBLE) AS number, TRY_CAST(moment AS TIMESTAMP) AS moment FROM (
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE value::VARCHAR END AS raw,
  CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events)""")
def _(t):
    raw = t("events").selectExpr(
        "event_id", "case when event_id % 9 = 0 then 'n/a' else cast(value as string) end as raw",
        "case when event_id % 4 = 0 then 'soon' else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end as moment")
    return raw.select("event_id", to_number(F.col("raw")).alias("number"), to_moment(F.col("moment")).alias("moment"))


@query("array_extremes", """SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS best,
  list_position(embedding, list_sort(embedding, 'DESC')[1]) || ',' || list_position(embedding, list_sort(embedding, 'DESC')[2])
  || ',' || list_position(embedding, list_sort(embedding, 'DESC')[3]) AS top FROM embeddings""")
def _(t):
    a = F.col("embedding")
    return t("embeddings").select("vec_id", argmax(a).alias("best"),
                                  F.array_join(top_positions(a, 3).cast("array<string>"), ",").alias("top"))


@query("word_tokens", r"""SELECT term, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY term""")
def _(t):
    return t("documents").select(F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))


@query("space_tokens", rf"""SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(
  regexp_split_to_array(lower(text), '[{SPACE_SQL}]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY term""")
def _(t):
    return t("documents").select(F.explode(space_tokens(F.lower("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))


@query("batch_function", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders")
def _(t):
    def gross(pdf):
        return pdf.assign(gross=(pdf["o_totalprice"] * 1.1))[["o_orderkey", "gross"]]

    return rounded(map_batches(t("orders").select("o_orderkey", "o_totalprice"), gross, "o_orderkey long, gross double"), 4)
