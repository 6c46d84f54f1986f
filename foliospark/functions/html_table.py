"""HTML tables as Markdown, with spans and header rows of several levels."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY_HEADER = " " * 6


class _Table(HTMLParser):
    """Rows of the first table: lists of (text, is header, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth = self.found = 0
        self.cell: list | None = None
        self.lines: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            self.found += self.depth == 1
        if self.found != 1 or not self.depth:
            return
        if tag == "tr" and self.depth == 1:
            self._end()
            self.rows.append([])
        elif tag in ("td", "th") and self.depth == 1:
            self._end()
            if not self.rows:
                self.rows.append([])
            self.cell, self.lines = ["", tag == "th", _span(a.get("rowspan")), _span(a.get("colspan"))], [[]]
        elif self.cell is not None:
            if tag == "img":
                self.lines[-1].append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
            elif tag == "br":
                self.lines.append([])

    def handle_endtag(self, tag):
        if self.found == 1 and self.depth:
            if self.cell is not None and tag in ("p", "div"):
                self.lines.append([])
            if self.depth == 1 and tag in ("td", "th", "tr", "table"):
                self._end()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.cell is not None and (words := " ".join(data.split())):
            self.lines[-1].append(words)

    def _end(self):
        if self.cell is not None:
            self.cell[0] = " / ".join(t for t in (" ".join(x) for x in self.lines) if t)
            self.rows[-1].append(self.cell)
            self.cell = None


def _span(value: str | None) -> int:
    try:
        return max(int(value or 1), 1)
    except ValueError:
        return 1


def html_table_to_markdown(html: str) -> str:
    """Markdown of the first table; html as it is if there is none or its spans collide.

    Leading rows of header cells only are the header, else the first row; a column's header is the path of its levels.
    A cell's text stands where its span begins, the rest of it is blank, and so are rows dropped that are blank all over.
    """
    p = _Table()
    p.feed(html)
    p.close()
    if not p.found:
        return html
    grid: dict[tuple[int, int], tuple[int, int, str, bool]] = {}
    for r, row in enumerate(p.rows):
        c = 0
        for text, head, down, across in row:
            while (r, c) in grid:
                c += 1
            for at in ((i, j) for i in range(r, r + down) for j in range(c, c + across)):
                if at in grid:
                    return html
                grid[at] = r, c, text, head
            c += across
    height = max((i for i, _ in grid), default=-1) + 1
    width = max((j for _, j in grid), default=-1) + 1
    levels = 0
    for i in range(height):
        own = [v for j in range(width) if (v := grid.get((i, j)))]
        if own and all(v[3] for v in own):
            levels = i + 1
        elif own:
            break
    levels = levels or min(1, height)
    heads = []
    for j in range(width):
        path: list[str] = []
        for i in range(levels):
            v = grid.get((i, j))
            if v and v[2].strip() and v[1] == j and (not path or path[-1] != v[2]):
                path.append(v[2])
        heads.append(" > ".join(path) or _EMPTY_HEADER)
    escaped = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in cells) + " |"
    out = [escaped(heads), escaped(["---"] * width)]
    for i in range(levels, height):
        cells = [v[2] if (v := grid.get((i, j))) and v[:2] == (i, j) else "" for j in range(width)]
        if any(cells):
            out.append(escaped(cells))
    return "\n".join(out)


def _convert(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else html_table_to_markdown(x))


def html_table_column(c):
    """html_table_to_markdown() of a column, by Arrow batches."""
    return F.pandas_udf(_convert, T.StringType())(c)
