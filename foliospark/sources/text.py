"""Plain text and HTML as documents, pages and elements."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.functions import geometry as G
from foliospark.functions.arrow import ROWS
from foliospark.functions.html_table import html_table_to_markdown
from foliospark.model import DOC, ELEMENT, PAGE, DocSet, complete

LINES_PER_PAGE = 40
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def line_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = LINES_PER_PAGE) -> DataFrame:
    """A text element for each line, ``per_page`` to a page, without box or font: (doc_id, page_number, seq, type, content, source). Null texts have none."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "content"))
    return lines.select("doc_id", (F.floor(F.col("pos") / per_page) + 1).cast("int").alias("page_number"), F.col("pos").cast("double").alias("seq"), F.lit("text").alias("type"), "content", F.lit("native").alias("source"))


def grid_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line_elements() with a made-up layout, for text that has none.

    Lines alternate between two columns of a 612 x 792 page, 37 points apart; the first of a page spans both. Short
    lines get larger, and capitalised ones bold type; lines with pipes a fixed-pitch one.
    """
    e = line_elements(docs, id_col, text_col)
    k = F.col("seq").cast("long") % LINES_PER_PAGE
    n = F.length("content")
    x0 = F.when(k % 2 == 1, 330.0).otherwise(72.0)
    y0 = 30.0 + 37.0 * F.floor(k / 2)
    x1 = F.when(k == 0, 540.0).otherwise(x0 + 6.0 * F.least(n, F.lit(40)))
    size = F.when(n <= 12, 18.0).when(n <= 40, 14.0).otherwise(10.0)
    bold = (n <= 60) & F.col("content").rlike("^[A-Z]")
    name = F.when(F.instr("content", "|") > 0, "Courier").otherwise("Serif")
    return e.withColumn("bbox", G.box(x0, y0, x1, y0 + 12.0)).withColumn("font", F.struct(name.alias("name"), size.alias("size"), bold.alias("bold"), F.lit(False).alias("italic")))


def _pages(elements: DataFrame) -> DataFrame:
    found = elements.groupBy("doc_id").agg(F.max("page_number").alias("last"))
    return complete(found.select("doc_id", F.explode(F.sequence(F.lit(1), "last")).alias("page_number")).withColumn("width", F.lit(PAGE_WIDTH)).withColumn("height", F.lit(PAGE_HEIGHT)).withColumn("page_type", F.lit("native")), PAGE)


def text_docset(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grid: bool = False) -> DocSet:
    """Texts as documents; pages are runs of lines."""
    e = complete((grid_elements if grid else line_elements)(docs, id_col, text_col))
    pages = _pages(e)
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct().join(counts, "doc_id", "left").withColumn("source_format", F.lit("text"))
    return DocSet(complete(d, DOC), pages, e)


_BLOCKS = {"p": "text", "li": "text", "td": "text", "th": "text", "div": "text", "blockquote": "text", "pre": "text", "title": "", "nav": "header", "header": "header", "footer": "footer", **{f"h{k}": "text" for k in range(1, 7)}}
_SILENT = {"script", "style", "title", "head", "template"}


class _Blocks(HTMLParser):
    """Text blocks in document order: (type, content, heading level, tag)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, int | None, str]] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.table: list[str] | None = None

    def _flush(self) -> None:
        content = " ".join("".join(self.text).split())
        self.text = []
        if not content or any(t in _SILENT for t in self.stack):
            return
        kind = next((_BLOCKS[t] for t in reversed(self.stack) if t in ("nav", "header", "footer")), "text")
        block = next((t for t in reversed(self.stack) if t in _BLOCKS), "")
        level = int(block[1]) if len(block) == 2 and block[0] == "h" and block[1].isdigit() else None
        if block == "li" and kind == "text":
            content = "- " + content
        self.out.append((kind, content, level, block))

    def handle_starttag(self, tag, attrs):
        if self.table is not None:
            self.table.append(self.get_starttag_text())
            return
        if tag == "table":
            self._flush()
            self.table = [self.get_starttag_text()]
            return
        if tag in _BLOCKS or tag in _SILENT:
            self._flush()
            if tag in ("p", "li") and self.stack and self.stack[-1] == tag:
                self.stack.pop()
            self.stack.append(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "img":
            a = dict(attrs)
            self._flush()
            self.out.append(("image", a.get("alt") or "", None, a.get("src") or ""))

    def handle_endtag(self, tag):
        if self.table is not None:
            self.table.append(f"</{tag}>")
            if tag == "table":
                self.out.append(("table", html_table_to_markdown("".join(self.table)), None, "table"))
                self.table = None
            return
        if tag in self.stack:
            self._flush()
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        (self.text if self.table is None else self.table).append(data)

    def close(self):
        super().close()
        self._flush()


def html_blocks(html: str | None) -> list[tuple[str, str, int | None, str]]:
    """(type, content, heading level, tag or image source) of each block of a page; none for null."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    return p.out


_FROM_HTML = T.StructType([f for f in ELEMENT.fields if f.name in ("doc_id", "page_number", "seq", "type", "content", "heading_level", "saved_path", "description")])


def html_rows(batches):
    """Batches of elements of batches (doc_id, html); each has those of a slice of pages, and no more are Python objects."""
    arrow = to_arrow_schema(_FROM_HTML)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS).to_pylist()
            rows = [{"doc_id": r["doc_id"], "page_number": 1, "seq": float(k), "type": kind, **({"content": "", "description": content, "saved_path": tag} if kind == "image" else {"content": content, "heading_level": level})} for r in part for k, (kind, content, level, tag) in enumerate(html_blocks(r["html"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def html_docset(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DocSet:
    """Web pages as documents of one page each: headings with their level, navigation as headers, footers, tables as Markdown, images."""

    named = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html"))
    e = named.mapInArrow(html_rows, _FROM_HTML).withColumn("source", F.lit("native"))
    d = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(url_col).alias("source_path"), F.lit("html").alias("source_format"), F.lit(1).alias("page_count"))
    p = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.lit("native").alias("page_type"))
    return DocSet(complete(d, DOC), complete(p, PAGE), complete(e, ELEMENT))
