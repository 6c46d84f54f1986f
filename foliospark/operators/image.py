"""Images: what they are, what text already says of them, and what a vision model adds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import geometry as G
from foliospark.functions.text import CJK, for_comparison, numbers, py_strip
from foliospark.model import DocSet, flag
from foliospark.operators.ocr import char_overlap, recognise, suppress
from foliospark.operators.table import covered_pages
from foliospark.sources.files import parse_json

BLANK_STD = 1.0
MAX_CHARS, SKIP_CHARS = 1200, 1200


def image_class(width, height, layout):
    """``blank`` without a size; ``decorative`` for specks, strips and icons; else by the layout's word for it, or ``informational``."""
    short, long = F.least(width, height), F.greatest(width, height)
    blank = F.coalesce(width, F.lit(0.0)) * F.coalesce(height, F.lit(0.0)) == 0
    slight = (short <= 4) | ((short <= 80) & (long / F.greatest(short, F.lit(1.0)) >= 12)) | ((width * height <= 12000) & (long <= 160)) | (short < 30)
    return F.when(blank, "blank").when(slight, "decorative").when(layout == "table", "table_image").when(layout == "text", "text_image").otherwise("informational")


def is_blank_image(content):
    """Whether an image's bytes decode to one shade of grey, or not at all. Needs an image library; without one the column raises."""

    def run(c: pd.Series) -> pd.Series:
        import io

        import numpy as np
        from PIL import Image

        def one(x):
            try:
                return bool(np.asarray(Image.open(io.BytesIO(x)).convert("L")).std() < BLANK_STD)
            except OSError:
                return True

        return c.map(one)

    return F.pandas_udf(run, T.BooleanType())(content)


def evidence(d: DocSet) -> DataFrame:
    """(doc_id, elem_id, text, table_text, best_overlap): what texts and tables of its page that overlap an image say, the largest overlap first.

    Inside a figure its own labels don't count. Images without a box have what recognition said of them.
    """
    i = d.elements.filter("type = 'image' and bbox is not null").select("doc_id", "page_number", "elem_id", F.col("bbox").alias("__i"), flag("vector_figure").alias("__vec"))
    t = d.elements.filter(F.col("type").isin("text", "table") & F.col("source").isin("ocr", "native") & F.col("bbox").isNotNull() & ~flag("skip_render") & (F.length(py_strip(F.col("content"))) > 0)).select("doc_id", "page_number", "type", "seq", "bbox", py_strip(F.col("content")).alias("said"))
    own = F.col("__vec") & G.holds(F.col("__i"), G.center_x(F.col("bbox")), G.center_y(F.col("bbox")))
    p = i.join(t, ["doc_id", "page_number"]).withColumn("o", G.overlap_of_smaller(F.col("__i"), F.col("bbox"))).filter((F.col("o") > 0) & ~own)
    every = F.array_sort(F.collect_list(F.struct((-F.col("o")).alias("k"), "seq", "type", "said")))
    found = p.groupBy("doc_id", "elem_id").agg(every.alias("s"), F.max("o").alias("best_overlap"))
    said = F.array_join(F.transform("s", lambda x: x.said), "\n")
    tables = F.array_join(F.transform(F.filter("s", lambda x: x.type == "table"), lambda x: x.said), "\n\n")
    found = found.select("doc_id", "elem_id", said.alias("text"), tables.alias("table_text"), "best_overlap")
    et, eb = py_strip(F.coalesce("evidence_text", F.lit(""))), py_strip(F.coalesce("evidence_table", F.lit("")))
    bare = d.elements.filter("type = 'image' and bbox is null").select("doc_id", "elem_id", py_strip(F.concat(et, F.lit("\n"), eb)).alias("text"), eb.alias("table_text"), F.lit(1.0).alias("best_overlap")).filter("text <> ''")
    return found.unionByName(bare)


def strong(best_overlap, text):
    return (best_overlap >= 0.5) | ((best_overlap >= 0.3) & (F.length(for_comparison(text)) >= 24))


def text_heavy(kind, visible, said):
    n = F.length(for_comparison(visible))
    lines_ = F.length(visible) - F.length(F.replace(visible, F.lit("\n"), F.lit("")))
    return (kind == "text_image") | (n >= 40) | (F.length(for_comparison(said)) >= 40) | ((lines_ >= 2) & (n >= 20))


def number_mismatch(a, b):
    x, y = numbers(a), numbers(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def is_chinese(text):
    """Whether ideographs prevail: twelve at least, and twice the Latin letters."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return cjk >= F.greatest(F.lit(12), 2 * F.regexp_count(text, F.lit("[A-Za-z]")))


def classify_images(d: DocSet, skip_decorative: bool = True) -> DocSet:
    """image_class, and whether an image needs a description: not if it is decorative or blank, or on a page that a table over several pages takes up."""
    on = ["doc_id", "page_number"]
    cov = covered_pages(d.elements).withColumn("__cov", F.lit(True))
    kind = image_class(F.col("width"), F.col("height"), F.col("layout_type"))
    e = d.elements.join(cov, on, "left").withColumn("image_class", F.when(F.col("type") == "image", F.coalesce("image_class", kind)).otherwise(F.col("image_class")))
    slight = F.col("image_class").isin("blank", "decorative") & F.lit(skip_decorative)
    new = (F.col("type") == "image") & ~flag("skipped") & (slight | F.col("__cov").isNotNull())
    e = e.withColumn("skip_reason", F.when(new, F.when(slight, F.col("image_class")).otherwise("covered_by_table")).otherwise(F.col("skip_reason"))).withColumn("skipped", F.when(new, F.lit(True)).otherwise(F.col("skipped")))
    e = e.withColumn("needs_vlm", F.when(F.col("type") == "image", ~flag("skipped")).otherwise(F.col("needs_vlm")))
    return d.with_elements(e.select(*d.elements.columns))


def prefer_native(d: DocSet, threshold: float = 0.5) -> DocSet:
    """Drawn figures that share more than half of the smaller box with an embedded image of their page are skipped: the image has its own pixels."""
    on = ["doc_id", "page_number"]
    live = d.elements.filter((F.col("type") == "image") & ~flag("skipped"))
    own = live.filter(~flag("vector_figure") & F.col("xref").isNotNull()).select(*on, F.col("bbox").alias("__n"))
    drawn = live.filter(flag("vector_figure")).select(*on, "elem_id", "bbox")
    twice = drawn.join(own, on).filter(G.overlap_of_smaller(F.col("bbox"), F.col("__n")) > threshold).select("doc_id", "elem_id").distinct().withColumn("__twice", F.lit(True))
    e = d.elements.join(twice, ["doc_id", "elem_id"], "left")
    hit = F.col("__twice").isNotNull()
    e = e.withColumn("skipped", F.when(hit, F.lit(True)).otherwise(F.col("skipped"))).withColumn("skip_reason", F.when(hit, "native_image_preferred").otherwise(F.col("skip_reason")))
    return d.with_elements(e.select(*d.elements.columns))


def picture_evidence(pictures: DataFrame, read: Callable[[list[bytes]], list[list[dict]]]) -> DataFrame:
    """(doc_id, page_number, seq, evidence_text, evidence_table): what recognition reads in pictures (doc_id, page_number, seq, image), for documents without boxes.

    A picture is a page of its own here. One without bytes, or that can't be read, has no row.
    """
    have = pictures.filter("image is not null").withColumn("render_width", F.lit(None).cast("double")).withColumn("render_height", F.lit(None).cast("double"))
    place = F.struct("doc_id", "page_number", "seq")
    named = have.withColumn("__k", F.xxhash64(place))
    read_ = recognise(named.select(F.col("__k").alias("doc_id"), F.lit(1).alias("page_number"), "image", "render_width", "render_height"), read).select(F.col("doc_id").alias("__k"), "blocks")
    solid = lambda table: F.transform(F.filter("blocks", lambda b: (F.length(py_strip(F.coalesce(b.text, F.lit("")))) > 0) & ((b.label == "table") == F.lit(table))), lambda b: py_strip(b.text))
    said = lambda a, by: F.when(F.size(a) > 0, F.array_join(a, by))
    found = named.select("doc_id", "page_number", "seq", "__k").join(read_, "__k").select("doc_id", "page_number", "seq", said(solid(False), "\n").alias("evidence_text"), said(solid(True), "\n\n").alias("evidence_table"))
    return found.filter("evidence_text is not null or evidence_table is not null")


def attach_evidence(d: DocSet, found: DataFrame) -> DocSet:
    """Image elements with what picture_evidence() found; those that are skipped stay as they are."""
    on = ["doc_id", "page_number", "seq"]
    e = d.elements.join(found.select(*on, F.col("evidence_text").alias("__t"), F.col("evidence_table").alias("__tt")), on, "left")
    ours = (F.col("type") == "image") & ~flag("skipped")
    for name, new in (("evidence_text", "__t"), ("evidence_table", "__tt")):
        e = e.withColumn(name, F.when(ours, F.coalesce(F.col(new), F.col(name))).otherwise(F.col(name)))
    return d.with_elements(e.select(*d.elements.columns))


def image_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, image_class, n, needs_vlm)."""
    return elements.filter("type = 'image'").groupBy("doc_id", "image_class").agg(F.count("*").alias("n"), F.sum(flag("needs_vlm").cast("int")).alias("needs_vlm"))


def use_evidence(d: DocSet, most: int = MAX_CHARS, threshold: int = SKIP_CHARS) -> DocSet:
    """Images that text covers well, with ``threshold`` characters or more and no table, are described by that text, and no model is asked."""
    ev = evidence(d).select("doc_id", "elem_id", F.col("text").alias("__t"), F.col("table_text").alias("__tt"), F.col("best_overlap").alias("__o"))
    e = d.elements.join(ev, ["doc_id", "elem_id"], "left")
    hit = flag("needs_vlm") & ~flag("embedded_image") & (F.col("__tt") == "") & text_heavy(F.col("image_class"), F.lit(""), F.col("__t")) & strong(F.col("__o"), F.col("__t")) & (F.length(for_comparison(F.col("__t"))) >= threshold)
    hit = F.coalesce(hit, F.lit(False))
    cut = F.when(F.length("__t") <= most, F.col("__t")).otherwise(F.concat(F.substring("__t", 1, most - 1), F.lit("…")))
    for name, value in (("description", cut), ("description_source", F.lit("ocr_overlap_evidence")), ("text_heavy", F.lit(True)), ("needs_vlm", F.lit(False))):
        e = e.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return d.with_elements(e.withColumn("evidence_text", F.coalesce("evidence_text", "__t")).select(*d.elements.columns))


def context_before(d: DocSet, n: int = 3) -> DataFrame:
    """(doc_id, elem_id, context): the last n texts before each image on its page."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    said = F.collect_list(F.when((F.col("type") == "text") & (F.length(py_strip(F.col("content"))) > 0), F.col("content"))).over(w)
    size = F.size("__s")
    return d.elements.withColumn("__s", said).filter("type = 'image'").select("doc_id", "elem_id", F.array_join(F.slice("__s", F.greatest(size - n + 1, F.lit(1)), n), "\n").alias("context"))


def describe(d: DocSet, ask: Callable[[dict], str], most: int = MAX_CHARS) -> DocSet:
    """What a vision model says of the images that need it, applied.

    ask gets {saved_path, context, evidence, image_class} on an executor and returns text, JSON if it can: image_type, summary, visible_text, markdown. Text and
    tables it read go to corrected_text and corrected_table, recognised elements they repeat aren't rendered, and the summary describes the image.
    """
    ev = evidence(d).select("doc_id", "elem_id", F.col("text").alias("evidence"), "best_overlap")
    rows = d.elements.filter(flag("needs_vlm")).select("doc_id", "elem_id", "saved_path", "image_class").join(context_before(d), ["doc_id", "elem_id"], "left").join(ev, ["doc_id", "elem_id"], "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    raw = ask({k: r[k] for k in ("saved_path", "context", "evidence", "image_class")})
                except Exception:
                    raw = ""
                found = parse_json(raw)
                ok = isinstance(found, dict)
                get = lambda k: str(found.get(k) or "").strip() if ok else ""  # noqa: B023, E731
                out.append((r["doc_id"], r["elem_id"], ok, get("image_type"), get("summary"), get("visible_text"), get("markdown"), r["evidence"] if isinstance(r["evidence"], str) else "", float(r["best_overlap"]) if r["best_overlap"] == r["best_overlap"] and r["best_overlap"] is not None else 0.0))
            yield pd.DataFrame(out, columns=["doc_id", "elem_id", "ok", "kind", "summary", "visible", "markdown", "said", "o"])

    a = rows.mapInPandas(run, "doc_id long, elem_id string, ok boolean, kind string, summary string, visible string, markdown string, said string, o double")
    return apply_answers(d, a, most)


def apply_answers(d: DocSet, answers: DataFrame, most: int = MAX_CHARS) -> DocSet:
    """The second half of :func:`describe`, in columns: answers (doc_id, elem_id, ok, kind, summary, visible, markdown, said, o) put on images."""
    cut = lambda c, n=most: F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))
    n = lambda c: F.length(for_comparison(c))
    visible, md = F.col("visible"), F.col("markdown")
    solid = F.size(F.filter(F.split("visible", "\n"), lambda x: F.length(py_strip(x)) > 0))
    tabular = (F.length("visible") >= 40) & (solid >= 4)
    table = F.when(md != "", md).when((visible != "") & ((F.col("kind") == "table") | tabular), visible).otherwise("")
    text = F.when((visible == "") | (table == visible), "").when((F.col("kind") == "text") | strong(F.col("o"), F.col("said")) | (n(visible) >= 40), visible).otherwise("")
    a = answers.withColumn("c_table", cut(table)).withColumn("c_text", cut(text)).withColumn("all", py_strip(F.concat("c_text", F.lit(" "), "c_table"))).withColumn("good", F.col("ok") & (n(F.col("all")) >= 10))
    used = a.filter("good").select("doc_id", F.col("elem_id").alias("__img"), for_comparison(F.col("all")).alias("__norm"))
    boxes = d.elements.filter("type = 'image'").select("doc_id", F.col("elem_id").alias("__img"), "page_number", F.col("bbox").alias("__i"))
    t = d.elements.filter(F.col("type").isin("text", "table") & (F.col("source") == "ocr") & ~flag("skip_render") & ~flag("skipped")).select("doc_id", "page_number", "elem_id", "bbox", for_comparison(F.col("content")).alias("__e"))
    hit = (F.coalesce(G.overlap_of_smaller(F.col("__i"), F.col("bbox")), F.lit(0.0)) > 0.3) | ((F.length("__e") >= 2) & F.contains(F.col("__norm"), F.col("__e")))
    pairs = used.join(boxes, ["doc_id", "__img"]).join(t, ["doc_id", "page_number"]).filter(hit)
    some = pairs.select("doc_id", F.col("__img").alias("elem_id"), F.lit(True).alias("__supp")).distinct()
    e = suppress(d.elements, pairs.select("doc_id", "elem_id"), "vlm_correction")
    e = e.join(a.select("doc_id", "elem_id", "ok", "kind", "summary", "visible", "markdown", "said", "o", "c_table", "c_text", "all", "good"), ["doc_id", "elem_id"], "left").join(some, ["doc_id", "elem_id"], "left")
    covered = F.col("good") & F.col("__supp").isNull() & strong(F.col("o"), F.col("said")) & (n(F.col("said")) >= 40) & ~flag("embedded_image")
    route = F.col("good") & ~covered
    own = F.coalesce(char_overlap(for_comparison(F.col("summary")), for_comparison(F.col("all"))), F.lit(0.0)) <= 0.6
    fallback = F.when(F.col("summary") != "", F.struct(F.col("summary").alias("d"), F.lit("vlm_summary").alias("s"))).when(visible != "", F.struct(visible.alias("d"), F.lit("vlm_visible_text").alias("s"))).when(md != "", F.struct(md.alias("d"), F.lit("vlm_markdown").alias("s"))).when((F.col("said") != "") & strong(F.col("o"), F.col("said")), F.struct(F.col("said").alias("d"), F.lit("ocr_overlap_evidence").alias("s")))
    after = F.when(F.col("summary") != "", F.struct(cut(F.col("summary"), 400).alias("d"), F.when(own, "vlm_summary").otherwise("vlm_summary_after_correction").alias("s")))
    has = F.col("ok").isNotNull()
    e = e.withColumn("__d", F.when(has & route, after).when(has, fallback))
    sets = {
        "corrected_text": F.when(route & (F.col("c_text") != ""), F.col("c_text")), "corrected_table": F.when(route & (F.col("c_table") != ""), F.col("c_table")),
        "vlm_type": F.when(F.col("kind") != "", F.col("kind")), "vlm_summary": F.when(F.col("summary") != "", cut(F.col("summary"), 400)),
        "description": cut(F.col("__d.d")), "description_source": F.col("__d.s"), "skipped": F.when(covered, F.lit(True)), "skip_reason": F.when(covered, "covered_by_native_text"),
        "text_heavy": F.when(has & text_heavy(F.coalesce("image_class", F.lit("")), F.coalesce("visible", F.lit("")), F.coalesce("said", F.lit(""))), F.lit(True)),
    }
    for name, value in sets.items():
        e = e.withColumn(name, F.coalesce(value, F.col(name)))
    return d.with_elements(e.select(*d.elements.columns))


__all__ = ["apply_answers", "classify_images", "context_before", "describe", "evidence", "image_class", "image_counts", "is_blank_image", "is_chinese", "number_mismatch", "strong", "text_heavy", "use_evidence"]
