"""Structure, completeness, model descriptions and product quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.evaluate.metrics import edit_distance
from foliospark.functions import geometry as G
from foliospark.functions.let import computed
from foliospark.functions.tables import table_shape
from foliospark.functions.text import first_line, for_comparison, numbers, py_strip
from foliospark.model import DocSet, flag
from foliospark.operators.ocr import char_overlap
from foliospark.runtime import materialise
from foliospark.sinks.markdown import INTERNAL, image_reference

TOLERANCE, HALLUCINATION, DUPLICATE = 0.2, 0.3, 0.6
LEAKS = (*INTERNAL, "skip_render", "description_source", "vlm_skipped_due_to")


def _warn(df: DataFrame, text, page="page_number") -> DataFrame:
    return df.select("doc_id", (F.col(page) if page else F.lit(None)).cast("int").alias("page_number"), text.alias("warning"))


def headings(elements: DataFrame) -> DataFrame:
    """Empty headings, levels that are skipped, and headings whose parent level hasn't come since the last shallower one; the level of a document's first is exempt."""
    h = elements.filter("heading_level > 0").select("doc_id", "page_number", "seq", F.col("heading_level").alias("lv"), first_line(F.col("content")).alias("title"))
    p = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": "))
    named = h.filter("title <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_number", "seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    lv = F.col("lv")
    e = named.withColumn("before", F.lag("lv").over(w)).withColumn("root", F.first("lv").over(w)).withColumn("__at", F.row_number().over(w))
    # The parent is there if the last heading before of a level up to it has just that level.
    last = F.lit(None).cast("int")
    for k in range(5, 0, -1):
        at_or_above = F.last(F.when(lv <= k, lv), True).over(past)
        last = F.when(lv == k + 1, at_or_above).otherwise(last)
    e = e.withColumn("__last", last)
    name = lambda c: c.cast("string")
    jump = _warn(e.filter("lv > before + 1"), F.concat(p, F.lit("heading level jump from H"), name(F.col("before")), F.lit(" to H"), name(lv), F.lit(" ("), "title", F.lit(").")))
    orphan = _warn(e.filter("lv > 1 and lv <> root and not coalesce(__last = lv - 1, false)"), F.concat(p, F.lit("orphan H"), name(lv), F.lit(" heading without H"), name(lv - 1), F.lit(" parent ("), "title", F.lit(").")))
    empty = _warn(h.filter("title = ''"), F.concat(p, F.lit("empty heading detected at level H"), name(lv), F.lit(".")))
    return empty.unionByName(jump).unionByName(orphan)


def empty_chapters(chapters: DataFrame) -> DataFrame:
    return _warn(chapters.filter(F.length(py_strip(F.col("markdown"))) == 0), F.concat(F.lit("Chapter file is empty: "), "file", F.lit(".")), None)


def _shown():
    image = F.coalesce(F.length("corrected_text") > 0, F.lit(False)) | F.coalesce(F.length("corrected_table") > 0, F.lit(False)) | (~flag("skipped") & ((F.length(F.coalesce("saved_path", F.lit(""))) > 0) | (F.length(image_reference()) > 0)))
    return ~flag("skip_render") & ~F.col("type").isin("header", "footer") & F.when(F.col("type") == "image", image).otherwise(F.length(py_strip(F.coalesce("content", F.lit("")))) > 0)


def markdown_tables(markdown):
    """How many tables a text of Markdown has: a line in pipes, then a separator."""
    ls = F.transform(F.split(markdown, "\n"), py_strip)
    row = lambda x: x.rlike(r"^\|.*\|\z")
    sep = lambda x: x.rlike(r"(?U)^\|?(?:[\s:-]+\|)+\s*\z")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("prev"), F.lit(False).alias("within"))

    def step(a, x):
        opens = ~a["within"] & row(a["prev"]) & sep(x)
        within = opens | (a["within"] & row(x))
        return F.struct((a["n"] + opens.cast("int")).alias("n"), F.when(a["within"] & ~within, x).when(within, F.lit("")).otherwise(x).alias("prev"), within.alias("within"))

    return F.aggregate(ls, start, step, lambda a: a["n"])


def completeness(d: DocSet, markdown: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Page markers, amount of text, references of images, and tables of markdown (doc_id, markdown) against the document's elements."""
    md = markdown.select("doc_id", F.coalesce("markdown", F.lit("")).alias("md"))
    want = d.elements.filter(_shown()).groupBy("doc_id").agg(F.array_sort(F.collect_set("page_number")).alias("want"))
    got = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("md", F.lit(r"<!-- PAGE (\d+) -->"), F.lit(1)), lambda x: x.cast("int"))))
    none = F.array().cast("array<int>")
    m = md.join(want, "doc_id", "full").select("doc_id", F.coalesce("md", F.lit("")).alias("md"), F.coalesce("want", none).alias("want")).withColumn("got", got)
    markers = _warn(m.filter(F.col("want") != F.col("got")), F.concat(F.lit("Page marker mismatch: expected "), F.size("want").cast("string"), F.lit(" rendered page(s), got "), F.size("got").cast("string"), F.lit(".")), None)
    said = F.when(F.col("type").isin("text", "table", "formula"), F.col("content")).when(F.col("type") == "image", py_strip(F.concat(F.coalesce("corrected_text", F.lit("")), F.lit("\n"), F.coalesce("corrected_table", F.lit("")))))
    src = d.elements.withColumn("said", said).filter(F.length(py_strip(F.col("said"))) > 0).groupBy("doc_id").agg(F.length(for_comparison(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "seq", "said"))), lambda x: x.said), "\n"))).alias("src"))
    plain = F.regexp_replace(F.regexp_replace("md", r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"(?mU)^\s*>\s?", "")
    v = src.join(md, "doc_id", "left").withColumn("out", F.length(for_comparison(F.coalesce(plain, F.lit(""))))).filter((F.col("src") > 0) & (F.abs(F.col("out") - F.col("src")) / F.col("src") > tolerance))
    volume = _warn(v, F.concat(F.lit("Rendered text volume drifted beyond tolerance: source="), F.col("src").cast("string"), F.lit(" chars, output="), F.col("out").cast("string"), F.lit(" chars.")), None)
    i = d.elements.filter((F.col("type") == "image") & _shown() & ~flag("skipped") & flag("needs_vlm")).select("doc_id", "page_number", F.coalesce("saved_path", F.lit("")).alias("path"), image_reference().alias("ref")).filter("path <> '' or ref <> ''").join(md, "doc_id", "left")
    there = (F.col("path") != "") & F.contains("md", "path") | (F.col("ref") != "") & F.contains("md", "ref")
    refs = _warn(i.filter(~F.coalesce(there, F.lit(False))), F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": image output missing rendered reference.")))
    t = d.elements.withColumn("k", F.when((F.col("type") == "table") & ~flag("skip_render"), 1).when(F.col("type") == "image", (markdown_tables(F.coalesce("corrected_table", F.lit(""))) > 0).cast("int")).otherwise(0)).groupBy("doc_id").agg(F.sum("k").alias("k")).join(md, "doc_id", "left").withColumn("n", markdown_tables(F.coalesce("md", F.lit(""))))
    tables = _warn(t.filter("k <> n"), F.concat(F.lit("Table count mismatch: document has "), F.col("k").cast("string"), F.lit(", markdown rendered "), F.col("n").cast("string"), F.lit(".")), None)
    return markers.unionByName(volume).unionByName(refs).unionByName(tables)


def hallucinations(d: DocSet, threshold: float = HALLUCINATION) -> DataFrame:
    """(doc_id, page_number, elem_id, distance, reason, warning): image descriptions that differ from the text at the same place, in their numbers, or in the shape of their table; reason is null where all is well."""
    i = d.elements.filter((F.col("type") == "image") & ~flag("skipped") & (F.length(py_strip(F.coalesce("description", F.lit("")))) > 0))
    i = i.filter(~((F.coalesce(F.col("description_source"), F.lit("")) == "vlm_summary") & (F.col("corrected_text").isNotNull() | F.col("corrected_table").isNotNull()))).filter("coalesce(description_source, '') <> 'ocr_overlap_evidence'")
    i = i.select("doc_id", "page_number", "elem_id", F.col("bbox").alias("__i"), "image_class", py_strip(F.col("description")).alias("said"))
    t = d.elements.filter(F.col("type").isin("text", "table") & F.col("source").isin("ocr", "native") & (F.length(py_strip(F.col("content"))) > 0)).select("doc_id", "page_number", "seq", "bbox", "content")
    p = i.join(t, ["doc_id", "page_number"]).withColumn("o", F.coalesce(G.overlap_of_smaller(F.col("__i"), F.col("bbox")), F.lit(0.0)))
    g = p.groupBy("doc_id", "page_number", "elem_id", "said", "image_class").agg(F.array_sort(F.collect_list(F.struct((-F.col("o")).alias("k"), "seq", "content"))).alias("s"))
    over = F.transform(F.filter("s", lambda x: x.k < 0), lambda x: x.content)
    rest = F.transform(F.slice(F.array_sort(F.transform("s", lambda x: F.struct(x.seq.alias("seq"), x.content.alias("content")))), 1, 3), lambda x: x.content)
    ev = F.when(F.size(over) > 0, F.array_join(over, "\n")).when(F.col("image_class").isin("text_image", "table_image"), F.array_join(rest, "\n"))
    e = computed(g, ev=ev).filter(F.length("ev") > 0)
    e = computed(e, distance=F.round(edit_distance(F.col("said"), F.col("ev")), 4))
    a, b = table_shape(F.col("said")), table_shape(F.col("ev"))
    x, y = numbers(F.col("said")), numbers(F.col("ev"))
    reason = F.when(a.isNotNull() & b.isNotNull() & (a != b), "table shape mismatch").when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), "number mismatch").when(F.col("distance") > threshold, F.concat(F.lit("distance="), F.format_string("%.2f", "distance")))
    text = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": low-confidence VLM description ("), "reason", F.lit(")."))
    return computed(e, reason=reason).select("doc_id", "page_number", "elem_id", "distance", "reason", text.alias("warning"))


def leaks(markdown: DataFrame) -> DataFrame:
    """Internal notes and HTML tables in what readers see; comments don't count."""
    body = F.regexp_replace("markdown", r"(?s)<!--.*?-->", "")
    m = markdown.select("doc_id", body.alias("b"))
    hit = F.filter(F.array(*(F.when(F.instr("b", x) > 0 if " " in x else F.col("b").rlike(rf"\b{x}\b"), F.lit(x)) for x in LEAKS)), lambda x: x.isNotNull())
    notes = _warn(m.select("doc_id", F.explode(hit).alias("x")), F.concat(F.lit("Placeholder/debug text detected in output: '"), "x", F.lit("'")), None)
    n = F.regexp_count("b", F.lit(r"(?i)<table[\s>]"))
    html = _warn(m.withColumn("n", n).filter("n > 0"), F.concat(F.lit("HTML table markup detected in output ("), F.col("n").cast("string"), F.lit(" occurrence(s)).")), None)
    return notes.unionByName(html)


def image_links(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """References without a file and files, (doc_id, path), without a reference: a full outer join."""
    r = markdown.select("doc_id", F.explode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("path")).distinct().withColumn("r", F.lit(True))
    f = files.select("doc_id", "path").distinct().withColumn("f", F.lit(True))
    j = r.join(f, ["doc_id", "path"], "full")
    text = F.when(F.col("f").isNull(), F.concat(F.lit("Image reference '"), "path", F.lit("' in Markdown but file not found on disk."))).when(F.col("r").isNull(), F.concat(F.lit("Image file '"), F.element_at(F.split("path", "/"), -1), F.lit("' on disk but not referenced in Markdown.")))
    return _warn(j.withColumn("w", text).filter("w is not null"), F.col("w"), None)


def duplicate_descriptions(d: DocSet) -> DataFrame:
    """Descriptions of text-heavy images that the page's text repeats by more than six tenths."""
    on = ["doc_id", "page_number"]
    i = d.elements.filter((F.col("type") == "image") & flag("text_heavy") & ~flag("skipped")).select(*on, for_comparison(F.coalesce("description", F.lit(""))).alias("said")).filter(F.length("said") >= 20)
    t = d.elements.filter(F.col("type").isin("text", "table") & (F.length(py_strip(F.col("content"))) > 0)).groupBy(*on).agg(for_comparison(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x.content), " ")).alias("body"))
    e = i.join(t, on).withColumn("o", char_overlap(F.col("said"), F.col("body"))).filter(F.col("o") > DUPLICATE)
    return _warn(e, F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": image description duplicates nearby body text ("), F.round(F.col("o") * 100).cast("int").cast("string"), F.lit("% overlap).")))


def verify(d: DocSet, markdown: DataFrame, chapters: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All warnings, each once: (doc_id, page_number, warning).

    Each check is run when this is called and its warnings are written: as one plan they would take minutes to lay out.
    """
    found = [hallucinations(d).filter("reason is not null").select("doc_id", "page_number", "warning"), headings(d.elements), completeness(d, markdown), leaks(markdown), duplicate_descriptions(d)]
    if chapters is not None:
        found.append(empty_chapters(chapters))
    if files is not None:
        found.append(image_links(markdown, files))
    return reduce(DataFrame.unionByName, [materialise(w, "warnings") for w in found]).distinct()


__all__ = ["completeness", "duplicate_descriptions", "empty_chapters", "hallucinations", "headings", "image_links", "leaks", "markdown_tables", "verify"]
