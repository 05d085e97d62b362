"""Corpus pipeline: cleaned, judged and deduplicated documents, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and gets what the stage before kept, read back from Parquet. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import knn_quality, line_dedup, packing, quality_rules, simhash
from millrace.runtime import settle

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# The classifier and the neighbours of a whole row decide beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lose too much."""
    return quality_rules.clean(docs)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote takes for good; it learns from the labelled rows of `documents`."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return knn_quality.keep_good(docs, labelled, labels)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stood before, equal or one edit away, go."""
    return line_dedup.without_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.without_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(docs, TOKENIZER, capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", clean_lines), ("quality_classifier", good_documents), ("line_dedup", first_lines),
    ("simhash_near_dedup", one_of_each), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
