"""A vision model's look at whole pages: what it is shown, and what of its corrections is taken over."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import py_strip
from foliospark.model import DocSet, flag
from foliospark.operators.fold import fold
from foliospark.sources.files import parse_json

MOST_PAGES, SHOWN = 50, 200
_NARROW = str.maketrans("，。：；（）！？、“”‘’", ",.:;()!?,\"\"''")
_MARKUP = re.compile(r"\\[()]|[{}$]|\s+")
KINDS = ("fix_text", "fix_table", "add_missing")


def pages_to_review(d: DocSet, all_pages: bool = False, most: int = MOST_PAGES) -> DataFrame:
    """(doc_id, page_number): scanned and mixed pages, or all, the first ``most`` of a document."""
    p = d.pages if all_pages else d.pages.filter(F.col("page_type").isin("scanned", "mixed"))
    return p.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).filter(F.col("__k") <= most).select("doc_id", "page_number")


def extraction_summary(d: DocSet) -> DataFrame:
    """(doc_id, page_number, summary): JSON of what each page has so far, with indexes by which corrections refer to it."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    t = py_strip(F.col("content"))
    long = F.length(t) > SHOWN
    e = d.elements.withColumn("index", F.row_number().over(w) - 1).filter(~flag("skip_render"))
    item = F.struct("index", "type", F.when(long, F.concat(F.substring(t, 1, SHOWN), F.lit("..."))).otherwise(t).alias("text"), F.when(long, F.length(t)).alias("text_length"), F.when(F.col("heading_level") > 0, F.lit(True)).alias("is_heading"), F.when(F.col("source") != "native", F.col("source")).alias("source"))
    return e.groupBy("doc_id", "page_number").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("summary"))


def parse_corrections(raw: str) -> list[dict]:
    """Corrections of a known kind in a model's answer."""
    found = parse_json(raw)
    found = found.get("corrections") if isinstance(found, dict) else found
    return [c for c in found if isinstance(c, dict) and c.get("type") in KINDS] if isinstance(found, list) else []


def format_only(a: str, b: str) -> bool:
    """Whether two texts differ in the width of punctuation, math delimiters and white space alone."""
    plain = lambda s: _MARKUP.sub("", s.translate(_NARROW))
    return plain(a) == plain(b)


def apply_corrections(rows: list[dict]) -> list[dict]:
    """A page's rows, each with the page's answer as ``__answer``, corrected.

    A fix must quote what it changes, change more than form, and not cut a table to less than half; the first occurrence is replaced.
    What is missing is put after the element named, or first.
    """
    added: list[dict] = []
    places = [r["seq"] for r in rows]
    for n, c in enumerate(parse_corrections(rows[0].get("__answer") or "") if rows else []):
        if c["type"] == "add_missing":
            if not c.get("content"):
                continue
            after = c.get("insert_after_index")
            k = max(-1, min(after if isinstance(after, int) else -1, len(rows) - 1))
            low = places[k] if k >= 0 else places[0] - 1
            high = places[k + 1] if k + 1 < len(places) else low + 1
            new = dict.fromkeys(rows[0])
            level = c.get("heading_level")
            new.update(doc_id=rows[0]["doc_id"], page_number=rows[0]["page_number"], seq=low + (high - low) * (n + 1) / 4096, elem_id=f"{rows[0]['elem_id']}/vlm{n}", type="table" if c.get("content_type") == "table" else "text", content=c["content"], source="vlm", heading_level=level if c.get("content_type") == "heading" and isinstance(level, int) else None)
            added.append(new)
            continue
        k, new_text, old = c.get("element_index"), c.get("corrected"), c.get("original") or ""
        if not isinstance(k, int) or not isinstance(new_text, str) or not 0 <= k < len(rows):
            continue
        e = rows[k]
        old = old.removesuffix("...")
        if old and (old not in (e["content"] or "") or format_only(old, new_text)):
            continue
        if c["type"] == "fix_table":
            if len(new_text) < 0.5 * len(e["content"] or ""):
                continue
            e["content"] = new_text
        else:
            e["content"] = e["content"].replace(old, new_text, 1) if old else new_text
        e["source"], e["spans"] = "vlm", None
    return sorted(rows + added, key=lambda r: r["seq"])


def review(d: DocSet, images: DataFrame, ask: Callable[[bytes, str], str], all_pages: bool = False) -> DocSet:
    """Pages to review, given as images (doc_id, page_number, image), shown to ask() with their summary, and its corrections applied."""
    on = ["doc_id", "page_number"]
    shown = pages_to_review(d, all_pages).join(images, on).join(extraction_summary(d), on)

    def run(batches):
        for pdf in batches:
            said = []
            for r in pdf.itertuples():
                try:
                    said.append(ask(bytes(r.image), r.summary))
                except Exception:
                    said.append(None)
            yield pdf[on].assign(__answer=pd.Series(said, dtype=object, index=pdf.index))

    answers = shown.select(*on, "image", "summary").mapInPandas(run, "doc_id long, page_number int, __answer string").filter("__answer is not null")
    e = fold(d.elements.join(answers, on), tuple(on), apply_corrections).select(*d.elements.columns)
    return d.with_elements(d.elements.join(answers.select(*on), on, "left_anti").unionByName(e))


__all__ = ["apply_corrections", "extraction_summary", "format_only", "pages_to_review", "parse_corrections", "review"]
