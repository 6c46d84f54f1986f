"""Fixed-pitch regions of documents that mix type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions.headings import NOT_CODE, is_monospace
from foliospark.model import DocSet, flag


def mark_code(d: DocSet) -> DocSet:
    """code_block on fixed-pitch text, in documents that have other text as well, unless it begins like a list item or with an ideograph."""
    live = (F.col("type") == "text") & ~flag("skip_render")
    mono = is_monospace(F.col("font.name"))
    doc = Window.partitionBy("doc_id")
    e = d.elements.withColumn("__mixed", F.max((live & mono).cast("int")).over(doc) + F.max((live & ~mono).cast("int")).over(doc) == 2)
    code = F.col("__mixed") & live & mono & ~F.col("content").rlike(NOT_CODE)
    return d.with_elements(e.withColumn("code_block", F.when(code, F.lit(True)).otherwise(F.col("code_block"))).drop("__mixed"))


def merge_code(d: DocSet) -> DocSet:
    """Code blocks that follow each other on a page as one: lines joined, boxes united."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    code = flag("code_block")
    e = d.elements.withColumn("__code", code).withColumn("__before", F.lag("__code", 1, False).over(page))
    e = e.withColumn("__run", F.sum(F.when(F.col("__code") & F.col("__before"), 0).otherwise(1)).over(page))
    run = Window.partitionBy("doc_id", "page_number", "__run")
    some = F.filter(F.array_sort(F.collect_list(F.struct("seq", "content")).over(run)), lambda x: x.content.isNotNull())
    joined = F.array_join(F.transform(some, lambda x, i: F.regexp_replace(F.when(i > 0, F.regexp_replace(x.content, r"^\n+", "")).otherwise(x.content), F.lit(r"(?U)\s+\z"), F.lit(""))), "\n")
    # The last one keeps the blanks it ends with.
    tail = F.regexp_extract(F.element_at(some, -1).content, r"(?U)(\s*)\z", 1)
    e = e.withColumn("__n", F.count("*").over(run)).withColumn("__joined", F.concat(joined, tail)).withColumn("__at", F.row_number().over(Window.partitionBy("doc_id", "page_number", "__run").orderBy("seq")))
    merged = F.col("__code") & (F.col("__n") > 1)
    bound = F.struct(F.min("bbox.x0").over(run).alias("x0"), F.min("bbox.y0").over(run).alias("y0"), F.max("bbox.x1").over(run).alias("x1"), F.max("bbox.y1").over(run).alias("y1"))
    e = e.withColumn("content", F.when(merged, F.col("__joined")).otherwise(F.col("content"))).withColumn("__bound", bound).withColumn("bbox", F.when(merged & F.col("bbox").isNotNull(), F.col("__bound")).otherwise(F.col("bbox"))).filter(F.col("__at") == 1)
    return d.with_elements(e.select(*d.elements.columns))


def code_blocks(d: DocSet) -> DocSet:
    return merge_code(mark_code(d))


__all__ = ["code_blocks", "mark_code", "merge_code"]
