"""Registry and small helpers of the workload."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import shared_dir
from millrace.schema import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared_dir(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0.0 becomes 0.0."""
    return df.select(*[(F.round(col(f.name), digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double"
                       else col(f.name) for f in df.schema.fields])


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def orders_with_gaps(table) -> DataFrame:
    """Orders with missing prices and priorities, made by a rule that SQL repeats."""
    return table("orders").withColumns({
        "o_totalprice": F.expr("case when o_orderkey % 7 = 0 then null else o_totalprice end"),
        "o_orderpriority": F.expr("case when o_orderkey % 11 = 0 then null else o_orderpriority end")})


ORDERS_WITH_GAPS = """gaps AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def customers_with_gaps(table) -> DataFrame:
    return table("customer").withColumns({
        "c_nationkey": F.expr("case when c_custkey % 11 = 0 then null else c_nationkey end"),
        "c_acctbal": F.expr("case when c_custkey % 7 = 0 then null else c_acctbal end")})


CUSTOMERS_WITH_GAPS = """gaps AS (SELECT c_custkey, c_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""


def embedding_columns(table) -> DataFrame:
    from millrace.operators.text import to_columns

    return to_columns(table("embeddings").drop("label"), "embedding", 64, "e")
