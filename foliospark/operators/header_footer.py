"""Running headers, footers and page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions.headings import is_page_number, running_text
from foliospark.functions.text import py_strip
from foliospark.model import DocSet

ZONE, THRESHOLD, RETAIN, BOTTOM = 0.08, 0.5, 2, 3
_EDGE_TYPES = ("text", "header", "footer")
_COUNTER = r"\d{1,4}\s*/\s*\d{1,4}\s*页"


def promote_section_headers(d: DocSet, zone: float = ZONE) -> DocSet:
    """``<name> N/M 页`` near the top of a page, in one line or two: the first of each name becomes a heading of level 1, the others go. Text that follows in the element stays."""
    # Documents are brought together once; joins and windows after this have doc_id among their keys.
    e = d.elements.repartition("doc_id").join(d.pages.select("doc_id", "page_number", F.col("height").alias("page_height")), ["doc_id", "page_number"], "left")
    # Without the sign no name is found, and nothing else here is asked of such text.
    raw = F.split(F.when(F.instr("content", "页") > 0, F.col("content")), "\n", -1)
    norm = F.transform(raw, lambda x: py_strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    one = py_strip(F.regexp_extract(F.get(norm, F.lit(0)), rf"(?U)^\s*(.+?)\s+{_COUNTER}\s*\z", 1))
    two = F.when(F.get(norm, F.lit(1)).rlike(r"(?U)^\d+\s*/\s*\d+\s*页\z") & F.length(F.get(norm, F.lit(0))).between(1, 20), F.get(norm, F.lit(0)))
    name = F.when(F.length(one) > 0, one).otherwise(two)
    top = (F.col("page_height") > 0) & (F.col("type") == "text") & (F.coalesce(F.col("bbox.y0"), F.lit(0.0)) < F.col("page_height") * max(2 * zone, 0.15))
    e = e.withColumn("__name", F.when(top & (F.length(name) <= 40), name)).withColumn("__skip", F.when(F.length(one) > 0, 1).otherwise(2))
    first = F.row_number().over(Window.partitionBy("doc_id", "__name").orderBy("page_number", "seq")) == 1
    body = F.array_join(F.slice(raw, F.col("__skip") + 1, F.greatest(F.size(raw) - F.col("__skip"), F.lit(0))), "\n")
    e = e.withColumn("__first", F.col("__name").isNotNull() & first).withColumn("__body", body)
    parts = F.filter(F.array(F.struct(F.col("__first").alias("on"), F.lit(True).alias("head")), F.struct((F.col("__name").isNull() | (F.length(py_strip(F.col("__body"))) > 0)).alias("on"), F.lit(False).alias("head"))), lambda p: p.on)
    e = e.withColumn("__part", F.explode(parts)).withColumn("__head", F.col("__part.head"))
    made = {
        "content": F.when(F.col("__head"), F.col("__name")).when(F.col("__name").isNotNull(), F.col("__body")).otherwise(F.col("content")),
        "bbox": F.when(F.col("__head") & F.col("bbox").isNotNull(), G.box(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y0"))).otherwise(F.col("bbox")),
        "heading_level": F.when(F.col("__head"), F.lit(1)).otherwise(F.col("heading_level")),
        "section_header": F.when(F.col("__head"), F.lit(True)).otherwise(F.col("section_header")),
        "seq": F.when(F.col("__head"), F.col("seq") - 0.5).otherwise(F.col("seq")),
        "elem_id": F.when(F.col("__head"), F.concat("elem_id", F.lit("/h"))).otherwise(F.col("elem_id")),
    }
    return d.with_elements(e.select(*(made[c].alias(c) if c in made else F.col(c) for c in d.elements.columns)))


def _edges(d: DocSet, zone: float) -> DataFrame:
    p = d.pages.select("doc_id", "page_number", F.col("height").alias("__h"))
    e = d.elements.join(p, ["doc_id", "page_number"], "left")
    y = G.center_y(F.col("bbox"))
    y = F.coalesce(y, F.lit(0.0))
    side = F.when(F.col("type").isin(*_EDGE_TYPES) & (F.col("__h") > 0), F.when(y < F.col("__h") * zone, "top").when(y > F.col("__h") * (1 - zone), "bottom"))
    return e.withColumn("__side", side).withColumn("__y", y).withColumn("__text", F.when(side.isNotNull(), running_text(F.col("content"))))


def repeated_edges(d: DocSet, zone: float = ZONE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, side, text, pages): what stands at the top or bottom of more than threshold of a document's pages, of two at least, numbers aside."""
    n = d.pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    found = _edges(d, zone).filter("__side is not null").groupBy("doc_id", F.col("__side").alias("side"), F.col("__text").alias("text")).agg(F.count_distinct("page_number").alias("pages"))
    return found.join(n, "doc_id").filter((F.col("__n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("__n") * threshold) + 1))).drop("__n")


def strip_headers_footers(d: DocSet, zone: float = ZONE, threshold: float = THRESHOLD, retain: int = RETAIN) -> DocSet:
    """Without repeated headers and footers and without page numbers, in documents of two pages or more.

    Of what goes on the first page the ``retain`` longest that aren't page numbers stay, marked, in place.
    """
    d = promote_section_headers(d, zone)
    doc = d.pages.groupBy("doc_id").agg(F.count("*").alias("__n"), F.min("page_number").alias("__first"))
    rep = repeated_edges(d, zone, threshold).select("doc_id", F.col("side").alias("__side"), F.col("text").alias("__text"), F.lit(True).alias("__rep"))
    e = _edges(d, zone).join(doc, "doc_id", "left").join(rep, ["doc_id", "__side", "__text"], "left")
    edge = F.col("type").isin(*_EDGE_TYPES)
    low = Window.partitionBy("doc_id", "page_number", edge).orderBy(F.desc("__y"), F.desc("bbox.y1"), "seq")
    number = is_page_number(F.col("content"))
    gone = edge & (F.col("__h") > 0) & (F.col("__n") >= 2) & (F.coalesce("__rep", F.lit(False)) | (number & ((F.col("__side") == "bottom") | (F.col("__low") <= BOTTOM))))
    e = e.withColumn("__low", F.row_number().over(low)).withColumn("__gone", F.coalesce(gone, F.lit(False))).withColumn("__kept", F.col("__gone") & (F.col("page_number") == F.col("__first")) & ~number)
    longest = Window.partitionBy("doc_id", "__kept").orderBy(F.desc(F.length(py_strip(F.col("content")))), "page_number", "seq")
    e = e.withColumn("__kept", F.col("__kept") & (F.row_number().over(longest) <= retain)).filter("not __gone or __kept")
    return d.with_elements(e.withColumn("retained_identity", F.when(F.col("__kept"), F.lit(True)).otherwise(F.col("retained_identity"))).select(*d.elements.columns))
