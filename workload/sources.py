"""Readers, sinks and the catalogue."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.plans.health import analyze, quality
from millrace.runtime import scratch_path
from millrace.schema import col
from millrace.sources.catalog import Catalog
from millrace.sources.readers import json_rows, read_object, read_table
from millrace.sources.writers import write_table
from workload.base import query, rounded


def through_csv(df, schema=None):
    """Written and read again by the engine's own functions; inferred types may be narrower than the written ones."""
    path = scratch_path(df.sparkSession, "round-trip") + ".csv"
    write_table(df, path, "csv")
    back = read_table(df.sparkSession, path, schema=schema)
    return back.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


@query("csv_round_trip", "SELECT * FROM orders")
def _(t):
    return through_csv(t("orders"))


@query("csv_round_trip_documents", "SELECT * FROM documents")
def _(t):
    """Texts with line breaks, quotes and commas."""
    return through_csv(t("documents"))


@query("csv_round_trip_events", "SELECT * FROM events")
def _(t):
    """JSON texts, all in quotes that hold quotes."""
    return through_csv(t("events"))


@query("csv_empty_and_missing", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL
  ELSE ' ' || o_orderpriority || chr(10) || '"' END AS note FROM orders""")
def _(t):
    note = F.expr("case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then null else concat(' ', o_orderpriority, '\n\"') end")
    return through_csv(t("orders").select("o_orderkey", note.alias("note")))


@query("json_round_trip", "SELECT * FROM part")
def _(t):
    df = t("part")
    path = scratch_path(df.sparkSession, "part") + ".jsonl"
    df.write.json(path)
    return read_table(df.sparkSession, path, schema=df.schema)


@query("parquet_scan", """SELECT l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
  FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag""")
def _(t):
    return (t("lineitem").filter("l_discount > 0.05").groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")))


@query("format_dispatch", " UNION ALL ".join(
    f"SELECT '{f}' AS format, count(*) AS rows, round(sum(c_acctbal), 2) AS balance FROM customer"
    for f in ("csv", "jsonl", "parquet")))
def _(t):
    df = t("customer")
    spark = df.sparkSession
    out = None
    for fmt in ("csv", "jsonl", "parquet"):
        path = f"{scratch_path(spark, 'customer')}.{fmt}"
        df.write.json(path) if fmt == "jsonl" else write_table(df, path, fmt)
        part = read_table(spark, path, schema=None if fmt == "csv" else df.schema).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        part = part.select(F.lit(fmt).alias("format"), "rows", "balance")
        out = part if out is None else out.unionByName(part)
    return out


@query("object_read", "SELECT * FROM supplier")
def _(t):
    df = t("supplier")
    spark = df.sparkSession
    folder, name = scratch_path(spark, "bucket"), "landing/supplier.parquet"
    write_table(df, f"{folder}/{name}", "parquet")
    # The folder stands in for a bucket; its path carries the scheme.
    return read_object(spark, folder, name, file_format="parquet", scheme="")


@query("json_objects", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    return json_rows(t("events").select("event_id", "props"), "props", "k bigint")


@query("json_nested_list", """SELECT user_id, event_id, round(value, 2) AS value FROM events""")
def _(t):
    # One response per user and page of a hundred ids, with its events in a list under data.items.
    item = F.struct("event_id", "value")
    responses = t("events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("body"))
    rows = json_rows(responses.select("user_id", "body"), "body", "event_id bigint, value double", "data.items")
    return rounded(rows, 2)


@query("sink_round_trip", "SELECT 'csv' AS format, * FROM events UNION ALL SELECT 'parquet' AS format, * FROM events")
def _(t):
    df = t("events")
    spark, out = df.sparkSession, None
    for fmt in ("csv", "parquet"):
        path = f"{scratch_path(spark, 'events')}.{fmt}"
        write_table(df, path, fmt)
        back = read_table(spark, path, schema=df.schema if fmt == "csv" else None)
        part = back.select(F.lit(fmt).alias("format"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


def _catalog(t) -> Catalog:
    """Datasets of the given tables under fixed ids and times."""
    customer = t("customer")
    spark = customer.sparkSession
    catalog = Catalog(spark, scratch_path(spark, "catalog"))
    made = [("customer", 1, "public", "Buyers and balances"), ("orders", 1, "private", "Sales of 100% of the regions"),
            ("part", 2, "public", None), ("supplier", 2, "shared", "Sellers and BALANCES")]
    for i, (name, owner, visibility, text) in enumerate(made):
        df = t(name)
        score = quality(analyze(df))["score"] if name == "part" else None
        catalog.register(df, name, owner, text, source_type="postgresql",
                         source_config={"host": "db", "port": 5432, "Password": "x", "my_api_key": "y"},
                         visibility=visibility, data_quality_score=score, dataset_id=f"set{i}",
                         pipeline_config=[{"type": "standardization", "parameters": {}}] if i == 0 else None,
                         created_at=datetime(2024, 1, 1 + i), order_by=[df.columns[0]])
    return catalog


@query("dataset_entries", """
SELECT 'set0' AS dataset_id, 'customer' AS dataset_name, 1::BIGINT AS owner_id, count(*) AS row_count,
  5::BIGINT AS column_count, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_names,
  (SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) AS first_names,
  'host,port' AS options, true AS pipeline_applied, 'public' AS visibility FROM customer
UNION ALL SELECT 'set1', 'orders', 1, count(*), 6,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', NULL, 'host,port', false, 'private' FROM orders
UNION ALL SELECT 'set2', 'part', 2, count(*), 6, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice', NULL, 'host,port',
  false, 'public' FROM part
UNION ALL SELECT 'set3', 'supplier', 2, count(*), 4, 's_suppkey,s_name,s_nationkey,s_acctbal', NULL, 'host,port', false,
  'shared' FROM supplier""")
def _(t):
    names = F.array_join(F.transform("sample", lambda m: m["c_name"]), ",")
    return _catalog(t).entries().select(
        "dataset_id", "dataset_name", "owner_id", "row_count", "column_count",
        F.array_join("column_names", ",").alias("column_names"),
        F.when(F.col("dataset_name") == "customer", names).alias("first_names"),
        F.array_join(F.array_sort(F.map_keys("source_config")), ",").alias("options"), "pipeline_applied", "visibility")


@query("dataset_reload", "SELECT * FROM customer")
def _(t):
    return _catalog(t).load("set0")


LISTED = ["dataset_id", "dataset_name", "row_count"]


@query("dataset_search", """SELECT 'set0' AS dataset_id, 'customer' AS dataset_name, count(*) AS row_count FROM customer
  UNION ALL SELECT 'set3', 'supplier', count(*) FROM supplier""")
def _(t):
    return _catalog(t).search("Balances").select(*LISTED)


@query("dataset_search_literal", "SELECT 'set1' AS dataset_id, 'orders' AS dataset_name, count(*) AS row_count FROM orders")
def _(t):
    return _catalog(t).search("0% of").select(*LISTED)


@query("dataset_public_page", "SELECT 'set0' AS dataset_id, 'customer' AS dataset_name, count(*) AS row_count FROM customer")
def _(t):
    return _catalog(t).list_public(limit=1, offset=1).select(*LISTED)


@query("dataset_owner_list", """SELECT 'set2' AS dataset_id, 'part' AS dataset_name, count(*) AS row_count FROM part
  UNION ALL SELECT 'set3', 'supplier', count(*) FROM supplier""")
def _(t):
    return _catalog(t).list_owned(2).select(*LISTED)
