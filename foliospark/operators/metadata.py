"""Font and numbering statistics of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.headings import NUMBERING, numbering_level, numbering_signal
from foliospark.functions.text import first_line
from foliospark.model import flag

HEADING_RATIO, MAX_CHAR_SHARE = 1.2, 0.1


def font_stats(elements: DataFrame, with_code: bool = True) -> DataFrame:
    """(doc_id, font, chars, first_page, first_seq, is_body): characters of each font; the body font has the most, the first seen of those that tie."""
    e = elements.filter("type = 'text'")
    if not with_code:
        e = e.filter(~flag("code_block"))
    f = e.withColumn("font", F.struct("font.name", "font.size", "font.bold"))
    stats = f.groupBy("doc_id", "font").agg(F.sum(F.length("content")).alias("chars"), F.min(F.struct("page_number", "seq")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first")
    return stats.withColumn("is_body", F.row_number().over(w) == 1).select("doc_id", "font", "chars", F.col("first.page_number").alias("first_page"), F.col("first.seq").alias("first_seq"), "is_body")


def body_fonts(stats: DataFrame) -> DataFrame:
    """(doc_id, body, body_chars)."""
    return stats.filter("is_body").select("doc_id", F.col("font").alias("body"), F.col("chars").alias("body_chars"))


def heading_candidates(stats: DataFrame, ratio: float = HEADING_RATIO, max_share: float = MAX_CHAR_SHARE) -> DataFrame:
    """(doc_id, font, heading_rank): fonts larger than the body's, or bold where it isn't, that aren't used too much; the largest has rank 1.

    Use is counted by size to half a point and weight, whatever the name.
    """
    group = Window.partitionBy("doc_id", F.round(F.col("font.size") * 2) / 2, "font.bold")
    doc = Window.partitionBy("doc_id")
    s = stats.withColumn("group_chars", F.sum("chars").over(group)).withColumn("body", F.max(F.when(F.col("is_body"), F.col("font"))).over(doc)).withColumn("body_chars", F.max(F.when(F.col("is_body"), F.col("chars"))).over(doc))
    larger = F.col("font.size") >= F.col("body.size") * ratio
    bolder = F.col("font.bold") & ~F.col("body.bold") & (F.col("font.size") >= F.col("body.size"))
    s = s.filter((F.col("body.size") > 0) & (larger | bolder) & ~((F.col("body_chars") > 0) & (F.col("group_chars") > F.col("body_chars") * max_share)))
    rank = Window.partitionBy("doc_id").orderBy(F.desc("font.size"), F.desc("font.bold"), "first_page", "first_seq")
    return s.select("doc_id", "font", F.row_number().over(rank).alias("heading_rank"))


def numbering_patterns(elements: DataFrame) -> DataFrame:
    """(doc_id, signal, level, n): how often first lines begin with each kind of numbering."""
    signal = numbering_signal(first_line(F.col("content")))
    level = F.create_map(*(x for name, _, lv in NUMBERING for x in (F.lit(name), F.lit(lv))))
    return elements.filter("type = 'text'").select("doc_id", signal.alias("signal")).filter("signal is not null").groupBy("doc_id", "signal").agg(F.count("*").alias("n")).select("doc_id", "signal", level[F.col("signal")].alias("level"), "n")


def page_types(pages: DataFrame) -> DataFrame:
    """(doc_id, page_types): a map of each document's pages."""
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", "page_type")))).alias("page_types"))


def processing_stats(elements: DataFrame) -> DataFrame:
    """(doc_id, headings, tables, images, skipped, code_blocks)."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return elements.groupBy("doc_id").agg(n(F.col("heading_level") > 0).alias("headings"), n(F.col("type") == "table").alias("tables"), n(F.col("type") == "image").alias("images"), n(flag("skip_render")).alias("skipped"), n(flag("code_block")).alias("code_blocks"))


__all__ = ["body_fonts", "font_stats", "heading_candidates", "numbering_level", "numbering_patterns", "page_types", "processing_stats"]
