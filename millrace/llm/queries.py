"""Registered queries of the operators: op1 to op13, each over its whole tables, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (byte_bpe, fill_middle, hilbert, knn_quality, license_scan, line_dedup, ngram_join, packing, quality_rules,
                          simhash, spelling, token_counts, url_filter)
from millrace.llm import oracles as sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def enter(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


@query("op1_quality_rules", sql.QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@query("op2_hilbert_search")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def fetched(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch time, so one is made from the id, over a year and a day."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 53 % 366 as int))").alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list log made from the pages: three of ten hosts, parent domains and path beginnings come and go."""
    host, path = url_filter.host_of(F.col("url")), url_filter.segments_of(F.col("url"))
    kind = F.col("page_id") % 20
    rule = (F.when(kind.isin(1, 7), host).when(kind.isin(3, 13), F.regexp_replace(host, r"^[^.]*\.", ""))
            .when(kind.isin(11, 17), F.concat_ws("/", host, F.get(path, F.lit(0)))))
    return pages.filter(kind.isin(1, 3, 7, 11, 13, 17)).select(
        rule.alias("rule"), F.when(kind.isin(1, 3, 11), "add").otherwise("remove").alias("action"),
        F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 360 as int))").alias("at"))


@query("op3_url_filter", sql.URL_FILTER)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(fetched(pages), dated_list(pages))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


@query("op4_knn_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


@query("op6_line_dedup", sql.LINE_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


@query("op7_license_scan", sql.LICENSE_SCAN)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query("op11_ngram_join")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op12_fill_middle", sql.FILL_MIDDLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_share=80)
    text = fill_middle.restore(F.col("output"), F.col("form"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(text, 256)}).drop("output")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
