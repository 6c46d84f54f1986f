"""Captions and what they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions.headings import caption_kind
from foliospark.functions.let import computed
from foliospark.functions.text import compact
from foliospark.model import DocSet, flag
from foliospark.operators.fold import fold

MAX_GAP = {"figure": 140.0, "table": 110.0}


def caption_candidates(d: DocSet) -> DataFrame:
    """(doc_id, page_number, cap_id, cap_order, cap_box, kind, text) of texts that read like a caption and aren't headings."""
    return _numbered(d).filter("kind is not null").select("doc_id", "page_number", F.col("elem_id").alias("cap_id"), F.col("__order").alias("cap_order"), F.col("bbox").alias("cap_box"), "kind", "text")


def _numbered(d: DocSet) -> DataFrame:
    """Elements by their order on the page, with kind and text of those that read like a caption; other texts don't move for it."""
    e = computed(d.elements, text=F.when((F.col("type") == "text") & (F.coalesce("heading_level", F.lit(0)) == 0) & ~flag("skip_render"), compact(F.col("content"))))
    e = computed(e, kind=caption_kind(F.col("text")))
    e = e.select("doc_id", "page_number", "seq", "elem_id", "type", "bbox", "skipped", "kind", F.when(F.col("kind").isNotNull(), F.col("text")).alias("text"))
    return e.withColumn("__order", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("seq")))


def caption_scores(d: DocSet) -> DataFrame:
    """Captions with the figures or tables of their page that they may belong to, and a score.

    With boxes: twice the share of width in common, a bonus on the usual side, less the gap against the largest allowed. Else, or where
    boxes say nothing, neighbours in order.
    """
    t = _numbered(d).filter(F.col("type").isin("image", "table") & ~flag("skipped")).select("doc_id", "page_number", F.col("elem_id").alias("to_id"), F.col("__order").alias("to_order"), F.col("bbox").alias("to_box"), F.when(F.col("type") == "image", "figure").otherwise("table").alias("kind"))
    p = caption_candidates(d).join(t, ["doc_id", "page_number", "kind"])
    c, b = F.col("cap_box"), F.col("to_box")
    common = F.least(c.x1, b.x1) - F.greatest(c.x0, b.x0)
    share = F.when(common > 0, common / F.greatest(F.least(G.width(c), G.width(b)), F.lit(1.0))).otherwise(0.0)
    above, below = b.y0 - c.y1, c.y0 - b.y1
    is_above = (above >= 0) & ((below < 0) | (above <= below))
    gap = F.when(is_above, above).when(below >= 0, below)
    most = F.when(F.col("kind") == "table", MAX_GAP["table"]).otherwise(MAX_GAP["figure"])
    usual = is_above == (F.col("kind") == "table")
    by_box = F.when(c.isNotNull() & b.isNotNull() & ((share >= 0.2) | G.center_x(c).between(b.x0, b.x1)) & (gap <= most), share * 2 + F.when(usual, 0.45).otherwise(0.1) - gap / most)
    apart = F.abs(F.col("cap_order") - F.col("to_order"))
    before = F.col("cap_order") < F.col("to_order")
    in_order = F.when(apart <= 1, 0.75 - 0.2 * apart + F.when(before == (F.col("kind") == "table"), 0.15).otherwise(0.0))
    return p.withColumn("score", F.coalesce(by_box, in_order)).filter("score is not null")


def assign(rows: list[dict]) -> list[dict]:
    """One to one: the best score first, then the order of captions and targets."""
    taken: set = set()
    out = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["cap_order"], r["to_order"])):
        if ("c", r["cap_id"]) not in taken and ("t", r["to_id"]) not in taken:
            taken |= {("c", r["cap_id"]), ("t", r["to_id"])}
            out.append(r)
    return out


def captions(d: DocSet) -> DocSet:
    """Figures and tables get their caption, which is then not rendered by itself. Captions that text recognition gave come first."""
    pre = (F.col("ocr_caption").isNotNull()) & F.col("caption").isNull()
    e = d.elements.withColumn("caption_kind", F.when(pre, "figure").otherwise(F.col("caption_kind"))).withColumn("caption", F.when(pre, F.col("ocr_caption")).otherwise(F.col("caption")))
    d = d.with_elements(e)
    pairs = fold(caption_scores(d).drop("cap_box", "to_box"), ("doc_id", "page_number"), assign, order=("cap_order", "to_order"))
    to = pairs.select("doc_id", F.col("to_id").alias("elem_id"), F.col("text").alias("__cap"), F.col("kind").alias("__kind"))
    by = pairs.select("doc_id", F.col("cap_id").alias("elem_id"), F.lit(True).alias("__is_cap"))
    e = e.join(to, ["doc_id", "elem_id"], "left").join(by, ["doc_id", "elem_id"], "left")
    e = e.withColumn("caption", F.coalesce("__cap", "caption")).withColumn("caption_kind", F.coalesce("__kind", "caption_kind")).withColumn("skip_render", F.coalesce("__is_cap", "skip_render"))
    return d.with_elements(e.select(*d.elements.columns))
