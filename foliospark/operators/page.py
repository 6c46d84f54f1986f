"""What characters, boxes and pages of a layout say: spacing, runs of type, lines, underlines, overlaps, and the kind of page."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions.text import CJK, py_strip
from foliospark.model import DocSet
from foliospark.sources.files import parse_json

_TIGHT = f"^[{CJK}　-〿＀-￯]"


def spaced_lines(chars: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number", "line")) -> DataFrame:
    """(by, text): characters (by, seq, c, x0, x1, size) joined, with a blank where the gap is more than an eighth of both sizes together, unless both are ideographs."""
    w = Window.partitionBy(*by).orderBy("seq")
    p = F.lag(F.struct("c", "x1", "size")).over(w)
    wide = (F.col("x0") - F.col("__p.x1") > 0.125 * (F.col("__p.size") + F.col("size"))) & ~(F.col("c").rlike(_TIGHT) & F.col("__p.c").rlike(_TIGHT)) & ~F.col("c").rlike(r"^\s") & ~F.col("__p.c").rlike(r"^\s")
    parts = chars.withColumn("__p", p).withColumn("__s", F.concat(F.when(wide, " ").otherwise(""), F.col("c")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "__s"))), lambda x: x["__s"]), "").alias("text"))


def format_runs(chars: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number", "block"), marks: tuple[str, ...] = ("bold", "italic", "underline", "sup")) -> DataFrame:
    """(by, run, text, marks): characters of the same type in a row."""
    w = Window.partitionBy(*by).orderBy("seq")
    key = F.struct(*marks)
    e = chars.withColumn("__key", key).withColumn("__new", F.when(F.lag(key).over(w).eqNullSafe(F.col("__key")), 0).otherwise(1)).withColumn("run", F.sum("__new").over(w))
    return e.groupBy(*by, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x.c), "").alias("text"), *(F.first(m).alias(m) for m in marks))


def join_rows(lines: DataFrame, by: tuple[str, ...] = ("doc_id", "page_number", "block")) -> DataFrame:
    """(by, text): lines (by, seq, text, y0, y1) of a block joined by a blank where they overlap by more than half of the lower one's height, else by a newline."""
    w = Window.partitionBy(*by).orderBy("seq")
    p = F.lag(F.struct("y0", "y1")).over(w)
    common = F.least("y1", F.col("__p.y1")) - F.greatest("y0", F.col("__p.y0"))
    beside = common / F.greatest(F.least(F.col("y1") - F.col("y0"), F.col("__p.y1") - F.col("__p.y0")), F.lit(1e-9)) > 0.5
    e = lines.withColumn("__p", p).withColumn("__s", F.concat(F.when(F.col("__p").isNull(), "").when(beside, " ").otherwise("\n"), "text"))
    return e.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "__s"))), lambda x: x["__s"]), "").alias("text"))


def underlined(chars: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page_number, char_id) of characters with a thin line from 1 above to 3 below their bottom along 0.3 of their width. Both have a ``bbox``."""
    r = rects.select("doc_id", "page_number", F.col("bbox").alias("__r")).filter((G.height(F.col("__r")) > 0) & (G.height(F.col("__r")) < 1.5) & (G.width(F.col("__r")) > 3))
    c, q = F.col("bbox"), F.col("__r")
    near = (q.y0 - c.y1).between(-1, 3) & ((F.least(c.x1, q.x1) - F.greatest(c.x0, q.x0)) >= 0.3 * F.greatest(G.width(c), F.lit(1e-9)))
    return chars.join(r, ["doc_id", "page_number"]).filter(near).select("doc_id", "page_number", "char_id").distinct()


def drop_text_in_tables(d: DocSet, share: float = 0.5) -> DocSet:
    """Without texts that lie within a table of their page by half of their area or more."""
    t = d.elements.filter("type = 'table' and bbox is not null").select(F.col("doc_id").alias("__d"), F.col("page_number").alias("__p"), F.col("bbox").alias("__t"))
    e = d.elements
    inside = (e["doc_id"] == F.col("__d")) & (e["page_number"] == F.col("__p")) & (e["type"] == "text") & (G.overlap_of_inner(e["bbox"], F.col("__t")) >= share)
    return d.with_elements(e.join(t, inside, "left_anti"))


def drop_small_images(d: DocSet, least: float = 10.0) -> DocSet:
    return d.with_elements(d.elements.filter((F.col("type") != "image") | F.col("width").isNull() | ((F.col("width") >= least) & (F.col("height") >= least))))


def classify_pages(d: DocSet) -> DocSet:
    """page_type by rules, the first that holds: hardly text and much image; little text and many drawings; text that lies on a dominant image; less text and some image; unreadable characters."""
    on = ["doc_id", "page_number"]
    b = F.col("bbox")
    text = d.elements.filter("type = 'text'")
    t = text.groupBy(*on).agg(F.sum(F.length("content")).alias("chars"), F.sum(F.length("content") - F.length(F.replace("content", F.lit("�"), F.lit("")))).alias("odd"))
    i = d.elements.filter("type = 'image' and bbox is not null").withColumn("a", G.width(b) * G.height(b)).groupBy(*on).agg(F.sum("a").alias("images"), F.max("a").alias("largest"), F.max_by("bbox", F.struct("a", -F.col("seq"))).alias("__big"))
    inside = text.join(i.select(*on, "__big"), on).filter(G.holds(F.col("__big"), G.center_x(b), G.center_y(b))).groupBy(*on).agg(F.sum(F.length("content")).alias("inside"))
    p = d.pages.join(t, on, "left").join(i.drop("__big"), on, "left").join(inside, on, "left").fillna(0, ["chars", "odd", "images", "largest", "inside"])
    page = F.col("width") * F.col("height")
    kind = (
        F.when(F.coalesce(page, F.lit(0.0)) == 0, "native")
        .when((F.col("chars") < 50) & (F.col("images") / page > 0.5), "scanned")
        .when((F.col("chars") < 500) & (F.coalesce("drawing_count", F.lit(0)) > 200), "scanned")
        .when((F.col("largest") / page > 0.5) & (F.col("chars") > 0) & (F.col("inside") > 0.7 * F.col("chars")), "scanned")
        .when((F.col("chars") < 200) & (F.col("images") / page > 0.3), "mixed")
        .when((F.col("chars") > 0) & (F.col("odd") > 0.05 * F.col("chars")), "scanned")
        .otherwise("native")
    )
    return d.with_pages(p.withColumn("page_type", kind).select(*d.pages.columns))


def page_quality(d: DocSet, layout: bool = False, short_share: float = 0.25) -> DataFrame:
    """(doc_id, page_number, reason, sample) of native pages whose text can't be trusted.

    ``layout`` (if asked for): most boxes are tiny, or large single characters abound. ``outlined``: a table's header is half empty.
    ``fragments``: a quarter of the lines are of five characters or fewer, which a model should confirm, given the sample.
    """
    on = ["doc_id", "page_number"]
    native = d.pages.filter("page_type = 'native'").select(*on, F.col("width").alias("pw"))
    e = d.elements.join(native, on)
    head = F.split(F.substring_index("content", "\n", 1), r"\|", -1)
    cells = F.transform(F.slice(head, F.lit(2), F.greatest(F.size(head) - 2, F.lit(0))), py_strip)
    blank = F.size(F.filter(cells, lambda c: F.length(c) == 0))
    outlined = e.filter((F.col("type") == "table") & (F.instr("content", "\n") > 0) & (F.size(cells) >= 3) & (blank >= 0.5 * F.size(cells))).select(*on).distinct().withColumn("reason", F.lit("outlined"))
    rows = F.filter(F.transform(F.split("content", "\n", -1), py_strip), lambda x: F.length(x) > 0)
    t = e.filter("type = 'text'").withColumn("n", F.size(rows)).withColumn("k", F.size(F.filter(rows, lambda x: F.length(x) <= 5)))
    frag = t.groupBy(*on).agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x.content), "\n"), 1, 2000).alias("sample")).filter((F.col("texts") >= 10) & (F.col("n") > 0) & (F.col("k") >= short_share * F.col("n")))
    out = outlined.withColumn("sample", F.lit(None).cast("string")).unionByName(frag.join(outlined, on, "left_anti").select(*on, F.lit("fragments").alias("reason"), "sample"))
    if layout:
        from foliospark.operators.metadata import body_fonts, font_stats

        sized = t.filter("bbox is not null").join(body_fonts(font_stats(d.elements)).select("doc_id", F.col("body.size").alias("body")), "doc_id", "left")
        big = (F.length(py_strip(F.col("content"))) <= 2) & (F.col("font.size") > F.when(F.col("body") > 0, F.col("body")).otherwise(10.0) * 1.05)
        bad = sized.groupBy(*on).agg(F.count("*").alias("texts"), F.avg((G.width(F.col("bbox")) < 0.15 * F.col("pw")).cast("int")).alias("tiny"), F.sum(F.when(big, 1).otherwise(0)).alias("big")).filter("texts >= 6 and (tiny > 0.5 or big > 2)")
        out = bad.select(*on, F.lit("layout").alias("reason"), F.lit(None).cast("string").alias("sample")).unionByName(out.join(bad, on, "left_anti"))
    return out


FRAGMENTS = 'Text of a page follows. If its formulas have come apart, so that their symbols stand on lines of their own, answer {"has_formula_fragments": true}, else {"has_formula_fragments": false}.'


def confirm_fragments(flagged: DataFrame, ask: Callable[[str, str], str]) -> DataFrame:
    """page_quality() with those ``fragments`` only that ask(system prompt, sample) confirms; a call that fails or can't be understood confirms nothing."""

    def run(batches):
        for pdf in batches:
            said = []
            for sample in pdf["sample"]:
                try:
                    answer = parse_json(ask(FRAGMENTS, sample))
                except Exception:
                    # The page keeps its text.
                    answer = None
                said.append(isinstance(answer, dict) and answer.get("has_formula_fragments") is True)
            yield pdf[pd.Series(said, index=pdf.index, dtype=bool)]

    some = flagged.filter("reason = 'fragments'")
    return flagged.filter("reason <> 'fragments'").unionByName(some.mapInPandas(run, some.schema))


def reclassify(d: DocSet, flagged: DataFrame) -> DocSet:
    """Pages of flagged (doc_id, page_number) as scanned."""
    f = flagged.select("doc_id", "page_number", F.lit(True).alias("__f")).distinct()
    p = d.pages.join(f, ["doc_id", "page_number"], "left").withColumn("page_type", F.when(F.col("__f"), "scanned").otherwise(F.col("page_type")))
    return d.with_pages(p.select(*d.pages.columns))


def merge_fragments(elements: DataFrame, parent: str = "parent") -> DataFrame:
    """Texts in a row with the same parent that aren't list items as one element with a span each."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "seq")
    joins = (F.col("type") == "text") & F.col(parent).isNotNull() & ~F.coalesce(F.col("layout_type") == "list_item", F.lit(False))
    e = elements.withColumn("__j", joins).withColumn("__same", F.col("__j") & F.lag("__j", 1, False).over(w) & F.col(parent).eqNullSafe(F.lag(parent).over(w)))
    e = e.withColumn("__run", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(w))
    span = F.struct(F.col("content").alias("text"), F.coalesce(F.col("font.bold"), F.lit(False)).alias("bold"), F.coalesce(F.col("font.italic"), F.lit(False)).alias("italic"), F.coalesce("underline", F.lit(False)).alias("underline"), F.lit(False).alias("sup"))
    run = Window.partitionBy("doc_id", "__run")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "seq", span.alias("s"))).over(run))
    e = e.withColumn("__spans", F.transform(ordered, lambda x: x.s)).withColumn("__k", F.row_number().over(run.orderBy("page_number", "seq"))).filter("__k = 1")
    several = F.size("__spans") > 1
    e = e.withColumn("content", F.when(several, F.array_join(F.transform("__spans", lambda s: s.text), "")).otherwise(F.col("content"))).withColumn("spans", F.when(several, F.col("__spans")).otherwise(F.col("spans")))
    return e.select(*elements.columns)


def fill_pages(pages: DataFrame) -> DataFrame:
    """Every page from 1 to a document's last; those without a row come with nulls."""
    every = pages.groupBy("doc_id").agg(F.max("page_number").alias("__last")).select("doc_id", F.explode(F.sequence(F.lit(1), "__last")).alias("page_number"))
    return every.join(pages, ["doc_id", "page_number"], "left").select(*pages.columns)
