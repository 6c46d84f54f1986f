"""Tables: dropping shells, and joining what a page break split."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.tables import is_degenerate, parse_table
from foliospark.model import DocSet
from foliospark.operators.fold import fold
from foliospark.runtime import void_columns

_SEPARATOR = re.compile(r"\|?[\s:|-]+(?:\|[\s:|-]+)+\|?")
_NUMBER = re.compile(r"[\s—-]*\d{1,5}[\s—-]*")


def drop_degenerate(d: DocSet) -> DocSet:
    return d.with_elements(d.elements.filter((F.col("type") != "table") | ~is_degenerate(F.col("content"))))


def parse(content: str) -> tuple[list[str], list[str], list[list[str]]]:
    """(header, separator, rows); all empty for fewer than two lines."""
    rows = [s for x in (content or "").splitlines() if (s := x.strip())]
    if len(rows) < 2:
        return [], [], []
    cut = lambda s: [c.strip() for c in s.removeprefix("|").removesuffix("|").split("|")]
    header = cut(rows[0])
    if _SEPARATOR.fullmatch(rows[1]):
        return header, cut(rows[1]), [cut(r) for r in rows[2:]]
    return header, ["---"] * len(header), [cut(r) for r in rows[1:]]


def build(header: list[str], separator: list[str], rows: list[list[str]]) -> str:
    n = len(header)
    body = [(r + [""] * n)[:n] for r in rows]
    return "\n".join(["| " + " | ".join(header) + " |", "|" + "|".join(separator) + "|", *("| " + " | ".join(r) + " |" for r in body)])


def _ignorable(e: dict) -> bool:
    return bool(e.get("skip_render")) or e["type"] in ("header", "footer") or e["type"] == "text" and bool(_NUMBER.fullmatch((e["content"] or "").strip()))


def merge_split_tables(rows: list[dict]) -> list[dict]:
    """A document's rows, each with its page's ``__height``, with tables joined over page breaks.

    The last table of a page, low on it, takes the first one of the next page, high on it, if they have as many columns, and goes on with the
    page after; pages of nothing but page numbers are passed over. A header that repeats is dropped, another becomes a row.
    """
    pages: dict[int, list[dict]] = {}
    for r in rows:
        pages.setdefault(r["page_number"], []).append(r)
    # A page without elements is passed over, so it needn't be here.
    order = sorted(pages)
    live = {n: [r for r in pages[n] if r["type"] is not None] for n in order}
    tables = {n: [r for r in live[n] if r["type"] == "table"] for n in order}
    gone: set[int] = set()
    for at, number in enumerate(order):
        own = [t for t in tables[number] if id(t) not in gone]
        if not own:
            continue
        table, height = own[-1], own[-1].get("__height") or 0.0
        bottom = (table.get("bbox") or {}).get("y1") or 0.0
        if not (bottom > 0.75 * height if height > 0 else bottom > 0):
            continue
        for following in order[at + 1 :]:
            others = [t for t in tables[following] if id(t) not in gone]
            if not others:
                if all(_ignorable(e) for e in live[following] if id(e) not in gone):
                    continue
                break
            other = others[0]
            tall, top = other.get("__height") or 0.0, (other.get("bbox") or {}).get("y0") or 0.0
            if not (top < 0.25 * tall if tall > 0 else top >= 0):
                break
            head, sep, body = parse(table["content"])
            head2, _, body2 = parse(other["content"])
            if not head or len(head) != len(head2):
                break
            body = body + ([] if head == head2 else [head2]) + body2
            table["content"], table["rows"] = build(head, sep, body), len(body) + 1
            before = table.get("merged_from")
            table["merged_from"] = [*(before if before is not None and len(before) else [number]), following]
            gone.add(id(other))
    return [r for r in rows if id(r) not in gone]


def merge_cross_page(d: DocSet) -> DocSet:
    """merge_split_tables() over documents with tables on two pages at least; the rest doesn't become Python values."""
    if "bbox" in void_columns(d.elements):
        # No table is low on its page.
        return d
    on, doc = F.when(F.col("type") == "table", F.col("page_number")), Window.partitionBy("doc_id")
    e = d.elements.join(d.pages.select("doc_id", "page_number", F.col("height").alias("__height")), ["doc_id", "page_number"], "left")
    # Documents are brought together once; both branches read that.
    e = e.withColumn("__several", F.coalesce((F.min(on).over(doc) < F.max(on).over(doc)) & F.col("doc_id").isNotNull(), F.lit(False)))
    merged = fold(e.filter("__several").drop("__several"), ("doc_id",), merge_split_tables, columns=("type", "content", "bbox", "rows", "merged_from", "skip_render", "__height"), together=True).select(*d.elements.columns)
    return d.with_elements(e.filter("not __several").select(*d.elements.columns).unionByName(merged))


def tables(d: DocSet) -> DocSet:
    return merge_cross_page(drop_degenerate(d))


REFINE = "These images are pages that one table runs over. Recognition read it as below. Put its errors and misplaced cells right, and answer with the whole table in Markdown and nothing else.\n\n{}"


def refine_merged(d: DocSet, images: DataFrame, ask: Callable[[list[bytes], str], str]) -> DocSet:
    """Tables that were merged over pages as ask(their pages' images, prompt) gives them; an answer that is no table, or a call that fails, changes nothing.

    images are rendered pages (doc_id, page_number, image); a table with fewer than two of them isn't asked about. Only such tables' pages are moved.
    """
    t = d.elements.filter("type = 'table' and size(merged_from) > 1").select("doc_id", "elem_id", "content", F.posexplode("merged_from").alias("k", "page_number"))
    pages = t.join(images.select("doc_id", "page_number", "image"), ["doc_id", "page_number"]).groupBy("doc_id", "elem_id", "content").agg(F.array_sort(F.collect_list(F.struct("k", "image"))).alias("shown")).filter(F.size("shown") > 1)

    def run(batches):
        for pdf in batches:
            said = []
            for r in pdf.itertuples():
                try:
                    answer = ask([bytes(x) for x in r.images], REFINE.format(r.content)).strip()
                except Exception:
                    # The table stays as it was read.
                    answer = ""
                said.append(answer if "|" in answer and "---" in answer else None)
            yield pdf[["doc_id", "elem_id"]].assign(__new=pd.Series(said, dtype=object, index=pdf.index))

    found = pages.select("doc_id", "elem_id", "content", F.transform("shown", lambda x: x.image).alias("images")).mapInPandas(run, "doc_id long, elem_id string, __new string").filter("__new is not null")
    e = d.elements.join(found, ["doc_id", "elem_id"], "left")
    e = e.withColumn("content", F.coalesce("__new", "content")).withColumn("source", F.when(F.col("__new").isNotNull(), "vlm").otherwise(F.col("source")))
    return d.with_elements(e.select(*d.elements.columns))


def covered_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number) of the pages that tables merged over several pages take up."""
    return elements.filter("size(merged_from) > 1").select("doc_id", F.explode("merged_from").alias("page_number")).distinct()


def cells(elements: DataFrame) -> DataFrame:
    """(elem_id, row, col, text) of each table's cells; the header is row 0."""
    t = elements.filter("type = 'table'").select("elem_id", parse_table(F.col("content")).alias("t"))
    rows = t.select("elem_id", F.posexplode(F.concat(F.array("t.header"), "t.rows")).alias("row", "cells"))
    return rows.select("elem_id", "row", F.posexplode("cells").alias("col", "text"))
