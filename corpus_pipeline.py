"""From raw documents to packed training windows: quality rules, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir). What it returns is written as Parquet and read again as the next one's docs.

All stages take rows with nulls in any column, repeated rows, ties, texts of any length, empty tables and more columns of any name, and keep all columns and
their order; only packing returns its own. What becomes of such rows each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.packing import pack
from foliospark.llm.quality_rules import keep_quality
from foliospark.llm.secret_scan import redact_secrets
from foliospark.llm.simhash import drop_near_duplicates
from foliospark.llm.token_counts import token_counts
from foliospark.runtime import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly boilerplate go, null, empty and blank texts with them. Rows that repeat are judged each. Of an empty table nothing comes."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id.

    Rows without a doc_id, and texts that are null or without a word, stay. Rows that share doc_id and text are one document and stay or go together.
    """
    return drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and n_chars follows; no row goes. Null and empty texts stay as they are."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The window and step group of each piece of each document. Null and empty texts have a row without a window; rows that repeat are packed each."""
    return pack(token_counts(docs), docs.count())


STAGES = [("quality_rules", quality_stage), ("simhash_near_dedup", near_dedup_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: SQL expresses neither the trained field nor the packing; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, so that a lost executor costs only its own stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
