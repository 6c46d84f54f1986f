"""The stages in order, and the calls that run them.

A run takes any number of documents. After a stage the elements are written to the shared folder, so that plans stay short and a lost
executor costs little.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.model import DocSet
from foliospark.operators.chapter import chapters
from foliospark.operators.clean import clean_elements
from foliospark.operators.code_block import code_blocks
from foliospark.operators.content_value import content_value
from foliospark.operators.crossref import captions
from foliospark.operators.formula import formulas
from foliospark.operators.formula_fix import correct_formulas
from foliospark.operators.header_footer import strip_headers_footers
from foliospark.operators.image import classify_images, describe, prefer_native, use_evidence
from foliospark.operators.line_unwrap import unwrap_elements
from foliospark.operators.ocr import block_elements, integrate, recognise
from foliospark.operators.page import classify_pages, confirm_fragments, drop_small_images, drop_text_in_tables, page_quality, reclassify
from foliospark.operators.reading_order import reading_order
from foliospark.operators.table import refine_merged, tables
from foliospark.operators.vlm_review import review
from foliospark.runtime import discard, materialise, reads_once
from foliospark.sinks.chapters import render_chapters, toc_index
from foliospark.sinks.markdown import render
from foliospark.sources.files import binary_docset
from foliospark.verify.checks import verify


@dataclass(frozen=True)
class Config:
    """What runs and how. The services are functions or None, which leaves their stages out."""

    page_quality: bool = True
    reading_order: bool = True
    header_zone: float = 0.08
    repetition: float = 0.5
    retain: int = 2
    value_threshold: float = 0.25
    value_gray: float = 0.1
    skip_decorative: bool = True
    disabled: frozenset[str] = frozenset()
    #: Rendered pages (doc_id, page_number, image, render_width, render_height), for recognition and review.
    page_images: DataFrame | None = None
    read: Callable | None = None
    classify_headings: Callable | None = None
    settle_breaks: Callable | None = None
    judge_value: Callable | None = None
    describe_image: Callable | None = None
    review_page: Callable | None = None
    confirm_fragments: Callable | None = None
    correct_formula: Callable | None = None
    refine_table: Callable | None = None


Stage = Callable[[DocSet, Config], DocSet]


def _recognition(d: DocSet, c: Config) -> DocSet:
    if c.read is None or c.page_images is None:
        return d
    from foliospark.operators.ocr import pages_to_read

    if c.page_quality:
        found = page_quality(d)
        d = reclassify(d, confirm_fragments(found, c.confirm_fragments) if c.confirm_fragments is not None else found.filter("reason <> 'fragments'"))
    images = c.page_images.join(pages_to_read(d).select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi")
    # Recognition costs; its results are kept, not worked out again for each that reads them.
    found = materialise(recognise(images, c.read), "recognised")
    return integrate(d, block_elements(found, d.pages))


def _images(d: DocSet, c: Config) -> DocSet:
    d = use_evidence(classify_images(prefer_native(d), c.skip_decorative))
    return describe(d, c.describe_image) if c.describe_image is not None else d


STAGES: list[tuple[str, Stage]] = [
    ("recognition", _recognition),
    ("reading_order", lambda d, c: reading_order(d) if c.reading_order else d),
    ("header_footer", lambda d, c: strip_headers_footers(d, c.header_zone, c.repetition, c.retain)),
    ("code_block", lambda d, c: code_blocks(d)),
    ("chapter", lambda d, c: chapters(d, c.classify_headings)),
    ("table", lambda d, c: refine_merged(tables(d), c.page_images, c.refine_table) if c.refine_table is not None and c.page_images is not None else tables(d)),
    ("image", _images),
    ("formula", lambda d, c: formulas(correct_formulas(d, c.page_images, c.correct_formula) if c.correct_formula is not None and c.page_images is not None else d)),
    ("line_unwrap", lambda d, c: unwrap_elements(d, c.settle_breaks)),
    ("text_clean", lambda d, c: clean_elements(d)),
    ("content_value", lambda d, c: content_value(d, c.value_threshold, c.value_gray, c.judge_value)),
    ("vlm_review", lambda d, c: review(d, c.page_images, c.review_page) if c.review_page is not None and c.page_images is not None else d),
    ("crossref", lambda d, c: captions(d)),
]
#: Stages that need boxes: documents without any, as from DOCX, HTML and text, skip them.
GEOMETRY = frozenset({"reading_order", "header_footer", "code_block", "content_value", "vlm_review"})
#: Stages that write tables of their own; what they are given is written first.
WRITING = frozenset({"recognition", "chapter"})


def prepared(d: DocSet) -> DocSet:
    """Documents as a reader gave them, ready for the stages: text that tables have is in them only, specks are left out, and pages are classified."""
    return classify_pages(drop_small_images(drop_text_in_tables(d)))


def read_documents(spark: SparkSession, path: str, readers: dict | None = None) -> DocSet:
    """PDF and Word files as documents."""
    return prepared(binary_docset(spark, path, readers))


def parse(d: DocSet, config: Config | None = None, geometry: bool = True) -> DocSet:
    """All stages over all documents; geometry=False for documents without boxes."""
    c = config or Config()
    skip = c.disabled | (frozenset() if geometry else GEOMETRY)
    source, before = d.elements, []

    def written(d: DocSet, name: str) -> DocSet:
        e = d.elements if hasattr(d.elements, "_stored_at") else materialise(d.elements, f"elements-{name}", narrow=True)
        # Nothing reads the stage before any more.
        discard(*(x for x in before if x is not e))
        before[:] = [e] if e is not source else []
        return replace(d, elements=e)

    # The stage whose elements aren't written yet. They are before a stage that reads them several times, or plans would multiply; one that passes over them once goes with it.
    last: str | None = "recognition"
    for name, stage in STAGES:
        if name in skip:
            continue
        if last and name in WRITING:
            d, last = written(d, last), None
        given, d = d, stage(d, c)
        if d is given:
            continue
        if last and not reads_once(d.elements, given.elements):
            given = written(given, last)
            d = stage(given, c)
        if d.pages is not given.pages:
            d = replace(d, pages=materialise(d.pages, f"pages-{name}", narrow=True))
        last = name
    return written(d, last) if last else d


@dataclass
class Result:
    """What a run gives: tables, all by doc_id."""

    documents: DocSet
    markdown: DataFrame
    chapters: DataFrame
    index: DataFrame
    warnings: DataFrame
    stats: DataFrame = field(repr=False)


def parse_result(d: DocSet, config: Config | None = None, geometry: bool = True) -> Result:
    """All stages, what they render, and what is wrong with it. Documents without elements have no Markdown; an empty table gives empty ones."""
    done = parse(d, config, geometry)
    if not hasattr(done.elements, "_stored_at"):
        done = done.with_elements(materialise(done.elements, "parsed", narrow=True))
    # What all checks read is rendered once.
    md, ch = materialise(render(done), "markdown"), materialise(render_chapters(done.elements), "chapters")
    return Result(done, md, ch, toc_index(done.elements), verify(done, md, ch), run_stats(done))


def run_stats(d: DocSet) -> DataFrame:
    """(doc_id, pages, page_types, elements, headings, tables, images, ocr_pages, described)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    e = d.elements.groupBy("doc_id").agg(F.count("*").alias("elements"), n(F.col("heading_level") > 0).alias("headings"), n(F.col("type") == "table").alias("tables"), n(F.col("type") == "image").alias("images"), F.count_distinct(F.when(F.col("source") == "ocr", F.col("page_number"))).alias("ocr_pages"), n(F.col("description").isNotNull()).alias("described"))
    p = d.pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_number", "page_type")))).alias("page_types"))
    return p.join(e, "doc_id", "left")
