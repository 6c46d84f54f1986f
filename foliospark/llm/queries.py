"""The registered queries of this subpackage and, where SQL can express them, their SQL.

Each query applies its operator to its whole table with the operator's default, that is production, parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.ann import nearest
from foliospark.llm.bpe import bpe_encode
from foliospark.llm.license_scan import scan_licenses
from foliospark.llm.packing import pack
from foliospark.llm.quality_rules import quality
from foliospark.llm.secret_scan import find_secrets
from foliospark.llm.simhash import near_groups
from foliospark.llm.token_counts import token_counts
from foliospark.llm.url_rules import filter_urls
from foliospark.llm.url_rules_sql import URL_FILTER
from foliospark.llm.warc import write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates, and whether it is the one of its group that stays."""
    return near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "keep")


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether decoding them gives its text again."""
    return bpe_encode(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, pre-tokens and pre-tokens that are one token."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all vectors, of every vector whose id is divisible by 100, approximately."""
    return nearest(_table(spark, sf_dir, "embeddings"), queries="vec_id % 100 = 0")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences, and what they amount to."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of content lines, and whether it stays."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a dictionary-compressed WARC file: where its record is."""
    return write_warc(_table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules that the labelled ones give."""
    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in every document."""
    return find_secrets(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window and step group of every piece of every document, by its number of tokens."""
    docs = _table(spark, sf_dir, "documents")
    return pack(token_counts(docs), docs.count())


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_bpe_encode, op3_token_counts, op4_nearest_neighbours, op5_license_scan, op6_quality_rules, op7_warc, op8_url_filter, op9_secret_scan, op10_packing)}

#: The others are no SQL: fingerprints, byte pairs, projections, trained weights, parsers and packing. Tests hold them against brute force.
ORACLES: dict[str, str] = {"op8_url_filter": URL_FILTER}
