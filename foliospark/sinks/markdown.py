"""Elements as Markdown, all in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.let import computed
from foliospark.functions.text import py_strip
from foliospark.model import DocSet, flag

#: Marks of internal notes that readers should never see.
INTERNAL = ("preserved in OCR body text", "preserved in body text")


def _flat(c: Column) -> Column:
    return py_strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def image_reference() -> Column:
    """What an image's reference says: its description, unless the body says it anyway, or it is an internal note."""
    text = _flat(F.col("description"))
    said = F.coalesce(F.col("description_source") == "ocr_overlap_evidence", F.lit(False)) & flag("text_heavy")
    internal = F.lit(False)
    for mark in INTERNAL:
        internal = internal | (F.instr(text, mark) > 0)
    return F.when(said | internal, "").otherwise(text)


def render_spans(spans: Column) -> Column:
    """Spans with their marks; neighbours of the same weight and slant share them."""

    def inner(s):
        t = F.when(F.coalesce(s.underline, F.lit(False)), F.concat(F.lit("<u>"), s.text, F.lit("</u>"))).otherwise(s.text)
        return F.when(F.coalesce(s["sup"], F.lit(False)), F.concat(F.lit("<sup>"), t, F.lit("</sup>"))).otherwise(t)

    mark = lambda s: F.concat(F.when(F.coalesce(s.bold, F.lit(False)), "**").otherwise(""), F.when(F.coalesce(s.italic, F.lit(False)), "*").otherwise(""))
    solid = F.filter(spans, lambda s: F.length(s.text) > 0)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("mark"))

    def add(acc, s):
        m = mark(s)
        same = acc["mark"] == m
        # The closing of one mark is its opening backwards; both are made of stars, so they are alike.
        return F.struct(F.concat(acc["out"], F.when(same, "").otherwise(F.concat(acc["mark"], m)), inner(s)).alias("out"), m.alias("mark"))

    return F.aggregate(solid, start, add, lambda acc: F.concat(acc["out"], acc["mark"]))


def _text() -> Column:
    c = F.col("content")
    spans = F.col("spans")
    said = F.array_join(F.transform(spans, lambda s: s.text), "")
    return (
        F.when(flag("code_block"), F.concat(F.lit("```\n"), c, F.lit("\n```")))
        .when(F.col("heading_level") > 0, F.concat(F.expr("repeat('#', heading_level)"), F.lit(" "), c))
        .when((F.size(spans) > 0) & (said == c), render_spans(spans))
        .when(flag("underline"), F.concat(F.lit("<u>"), c, F.lit("</u>")))
        .otherwise(c)
    )


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 0), "\n\n")


def _if(c: Column, before: str, after: str) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit(before), c, F.lit(after))).otherwise("")


def _image() -> Column:
    path, cap = F.coalesce("saved_path", F.lit("")), py_strip(F.coalesce("caption", F.lit("")))
    own = F.coalesce("description", F.lit(""))
    flat = _flat(F.when(F.length(own) > 0, own).otherwise(F.coalesce("vlm_summary", F.lit(""))))
    ref = F.when(F.length(own) > 0, image_reference()).otherwise(flat)
    text, table = py_strip(F.coalesce("corrected_text", F.lit(""))), py_strip(F.coalesce("corrected_table", F.lit("")))
    diagram = flag("vector_figure") | F.coalesce(F.col("vlm_type").isin("diagram", "chart"), F.lit(False))
    text, table = F.when(diagram, "").otherwise(text), F.when(diagram, "").otherwise(table)
    shown = lambda alt: F.concat(F.lit("!["), alt, F.lit("]("), path, F.lit(")"))
    caption = _if(cap, "*", "*")
    embedded = _joined(shown(F.when(flat != "", flat).otherwise(F.coalesce("vlm_type", F.lit("document image")))), _if(flat, "> ", ""), caption, text, table)
    corrected = _joined(text, table, F.when((flat != "") & (image_reference() != ""), F.when(path != "", shown(image_reference())).otherwise(F.concat(F.lit("*"), image_reference(), F.lit("*")))).otherwise(""), caption)
    body = F.when((path != "") & (flat != ""), F.concat(shown(F.when(ref != "", ref).otherwise(flat)), F.lit("\n\n> "), flat)).when(path != "", shown(F.lit(""))).when((flat != "") & (ref != ""), F.concat(F.lit("> [图片] "), ref)).otherwise("")
    return F.when(flag("embedded_image") & (path != ""), embedded).when((text != "") | (table != ""), corrected).when(flag("skipped") | (body == ""), "").otherwise(_joined(body, caption))


def render_element() -> Column:
    """An element's Markdown; empty for what isn't shown."""
    cap = py_strip(F.coalesce("caption", F.lit("")))
    c = F.coalesce("content", F.lit(""))
    return (
        F.when(flag("skip_render") | F.col("type").isin("header", "footer"), "")
        .when(F.col("type") == "text", F.coalesce(_text(), F.lit("")))
        .when(F.col("type") == "table", F.when(cap != "", F.concat(F.lit("**"), cap, F.lit("**\n\n"), c)).otherwise(c))
        .when(F.col("type") == "image", _image())
        .when(F.col("type") == "formula", F.when(flag("inline"), F.concat(F.lit("$"), c, F.lit("$"))).otherwise(F.concat(F.lit("$$\n"), c, F.lit("\n$$"))))
        .otherwise(c)
    )


def _in_order(key: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])


def render_pages(elements: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(by, page_number, markdown): a page's elements apart by blank lines below a page marker; pages that show nothing are left out."""
    parts = computed(elements, md=render_element()).filter(F.length("md") > 0)
    return parts.groupBy(*by, "page_number").agg(F.concat(F.lit("<!-- PAGE "), F.col("page_number").cast("string"), F.lit(" -->\n"), F.array_join(_in_order("seq", "md"), "\n\n")).alias("markdown"))


def render(d: DocSet) -> DataFrame:
    """(doc_id, markdown) of each document that shows anything."""
    return render_pages(d.elements).groupBy("doc_id").agg(F.array_join(_in_order("page_number", "markdown"), "\n\n").alias("markdown"))
