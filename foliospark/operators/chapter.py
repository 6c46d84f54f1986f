"""Headings and their levels."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import headings as H
from foliospark.functions.let import computed, let
from foliospark.functions.text import WHITE, first_line, py_strip, truncate
from foliospark.model import DocSet, flag
from foliospark.operators.fold import fold
from foliospark.operators.metadata import body_fonts, font_stats, heading_candidates
from foliospark.runtime import discard, materialise, void_columns

ISOLATION, SAME_SIZE = 1.4, 0.5
COHERENT_MOST, ORPHANS, ORPHAN_DEPTH, FALLBACK_BATCH, FALLBACK_DENSITY = 8, 5, 3, 40, 8
_TAIL = re.compile(r"(?:\.{2,}|-{2,}|—+|…+|\s)\d{1,4}\s*$")
_TOC_NAMES = frozenset(n.replace(" ", "").replace("　", "") for n in H.TOC_NAMES)


def mark_toc(rows: list[dict]) -> list[dict]:
    """A page's rows with tables of contents marked: a header, then short lines of which two at least end with a number; one in a row may lack it."""
    at = 0
    while at < len(rows):
        text = (rows[at]["content"] or "").strip()
        name = re.sub(r"\s+", "", re.sub(r"^\s{0,3}#{1,6}\s*", "", text).replace("**", "")).lower()
        at += 1
        if rows[at - 1]["type"] != "text" or "\n" in text or len(text) > 28 or name not in _TOC_NAMES:
            continue
        entries, slack, k = [], 0, at
        while k < len(rows) and rows[k]["type"] == "text":
            line = (rows[k]["content"] or "").strip()
            if line:
                if "\n" in line or len(line) > 80:
                    break
                slack = 0 if _TAIL.search(line) else slack + 1
                if slack and (slack > 1 or not entries):
                    break
                entries.append(rows[k])
            k += 1
        if sum(bool(_TAIL.search((e["content"] or "").strip())) for e in entries) >= 2:
            rows[at - 1].update(heading_level=1, toc_header=True)
            for e in entries:
                e.update(toc_entry=True, heading_level=None)
            at = k
    return rows


def _toc_header():
    named = F.lower(F.regexp_replace(F.regexp_replace("content", r"(?U)^\s{0,3}#{1,6}\s*|\*\*", ""), r"(?U)\s+", "")).isin(*_TOC_NAMES)
    # A longer text is no header; Python strips four more characters than patterns take for white space.
    short = F.length(F.trim("content", F.lit(WHITE + "\x1c\x1d\x1e\x1f"))) <= 28
    return (F.col("type") == "text") & short & named


def toc_blocks(d: DocSet) -> DocSet:
    """mark_toc() on the pages that have such a header; other pages don't become Python values. Rows are moved by page once, and both branches read that."""
    on = ["doc_id", "page_number"]
    found = F.max(_toc_header()).over(Window.partitionBy(*on))
    e = d.elements.withColumn("__toc", F.coalesce(found & F.col("doc_id").isNotNull() & F.col("page_number").isNotNull(), F.lit(False)))
    marked = fold(e.filter("__toc").drop("__toc"), tuple(on), mark_toc, columns=("type", "content", "heading_level", "toc_header", "toc_entry"), together=True, changes=("heading_level", "toc_header", "toc_entry")).select(*d.elements.columns)
    return d.with_elements(e.filter("not __toc").select(*d.elements.columns).unionByName(marked))


def isolated(d: DocSet, candidates: DataFrame) -> DataFrame:
    """(doc_id, elem_id): those of candidates (doc_id, page_number, elem_id, seq, bbox) with a gap of 1.4 lines or more to the last text before that is above and shares half their width. Without such a text there is no gap."""
    c = candidates.select("doc_id", "page_number", F.col("elem_id").alias("__id"), F.col("seq").alias("__seq"), F.col("bbox").alias("__b"))
    p = d.elements.filter("type = 'text' and bbox is not null").select("doc_id", "page_number", "seq", "bbox")
    b, q = F.col("__b"), F.col("bbox")
    pair = c.join(p, ["doc_id", "page_number"]).filter((F.col("seq") < F.col("__seq")) & (q.y1 <= b.y0) & (F.least(b.x1, q.x1) - F.greatest(b.x0, q.x0) >= 0.5 * F.greatest(G.width(b), F.lit(1.0))))
    near = pair.groupBy("doc_id", "__id").agg(F.max_by(q.y1, F.col("seq")).alias("bottom"), F.first("__b").alias("__b"))
    return near.filter(b.y0 - F.col("bottom") >= ISOLATION * F.greatest(G.height(b), F.lit(1.0))).select("doc_id", F.col("__id").alias("elem_id"))


def default_ocr_level(elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, ocr_level): the level of recognised titles without a number: 3 where the document's own text prevails and its headings have three sizes or more, else 2."""
    sizes = candidates.filter("font.size > 0").groupBy("doc_id").agg(F.count_distinct(F.round(F.col("font.size") * 2)).alias("sizes"))
    n = lambda s: F.sum(F.when(F.col("source") == s, F.length("content")).otherwise(0))
    chars = elements.filter("type = 'text'").groupBy("doc_id").agg(n("native").alias("native"), n("ocr").alias("ocr"))
    deep = (F.coalesce("sizes", F.lit(0)) >= 3) & (F.col("native") + F.col("ocr") > 0) & (F.col("native") >= F.col("ocr"))
    return chars.join(sizes, "doc_id", "left").select("doc_id", F.when(deep, 3).otherwise(2).alias("ocr_level"))


def detect_headings(d: DocSet) -> DocSet:
    """heading_level by numbering and type; levels that came with an element are checked.

    Both signals together give the numbering's level. Numbering alone must be of a strong kind. Type alone must be short, no label with
    a value, and if it is no larger than the body's, stand apart. Where no fonts are known, bold type with numbering counts.
    """
    stats = font_stats(d.elements)
    cand = heading_candidates(stats)
    # Where the body's font has no size, no font is a heading's, and it isn't asked for.
    body = body_fonts(stats).filter("body.size > 0")
    pages = d.pages.select("doc_id", "page_number", F.col("width").alias("__pw"))
    ranks = cand.select(F.col("doc_id").alias("__rd"), F.col("font").alias("__rf"), "heading_rank")
    has = cand.select("doc_id").distinct().withColumn("__has", F.lit(True))
    # Documents are brought together once; all joins below have doc_id among their keys.
    e = d.elements.repartition("doc_id").withColumn("__font", F.struct("font.name", "font.size", "font.bold"))
    e = e.join(ranks, (F.col("doc_id") == F.col("__rd")) & F.col("__font").eqNullSafe(F.col("__rf")), "left").drop("__rd", "__rf")
    e = e.join(body, "doc_id", "left").join(has, "doc_id", "left").join(default_ocr_level(d.elements, cand), "doc_id", "left").join(pages, ["doc_id", "page_number"], "left")
    e = computed(e, __head=H.heading_text(F.col("content")))
    h, num, signal = F.col("__head"), F.col("__num"), F.col("__signal")
    open_ = (F.col("type") == "text") & ~flag("code_block") & ~flag("retained_identity") & ~flag("toc_entry") & ~flag("toc_header")
    # Nothing asks how body text is numbered, unless it came with a level.
    asked = open_ & ((F.length(h) <= 100) | (F.col("heading_level") > 0))
    e = computed(e, __signal=F.when(asked, H.numbering_signal(h)), __num=F.when(asked, H.numbering_level(h)))
    by_font = F.when(F.col("heading_rank").isNotNull(), F.least(F.col("heading_rank"), F.lit(3)))
    short, meta, body_like = H.is_short(h), H.is_metadata(h), H.is_body(h)
    weak = (F.col("body.size") > 0) & (F.col("font.size") <= F.col("body.size") + SAME_SIZE)
    e = e.withColumn("__needs_gap", open_ & by_font.isNotNull() & num.isNull() & weak & F.col("bbox").isNotNull() & short & ~meta & ~body_like)
    apart = isolated(d, e.filter("__needs_gap").select("doc_id", "page_number", "elem_id", "seq", "bbox")).withColumn("__apart", F.lit(True))
    e = e.join(apart, ["doc_id", "elem_id"], "left")
    strong = signal.isin(*H.STRONG)
    no_fonts = F.col("__has").isNull() & F.coalesce(F.col("font.bold"), F.lit(False))
    colon_ok = ~H.ends_with_colon(h) | signal.isin(*H.STRONG_WITH_COLON)
    rejected = F.col("__needs_gap") & F.col("__apart").isNull()
    found = (
        F.when(body_like | H.is_not_heading(h), F.lit(None).cast("int"))
        .when(by_font.isNotNull() & num.isNotNull(), num)
        .when(num.isNotNull() & strong & short & ~meta, num)
        .when(by_font.isNotNull() & short & ~meta & ~rejected, by_font)
        .when(no_fonts & num.isNotNull() & short & ~meta & colon_ok, num)
    )
    right = (F.col("__pw") > 0) & (F.coalesce(F.col("bbox.x0"), F.lit(0.0)) >= F.col("__pw") * 0.6)
    line = first_line(F.col("content"))
    is_ocr = F.col("source") == "ocr"
    sidebar = F.when(is_ocr & (F.col("layout_type").isNull() | (F.col("layout_type") == "text")) & right & F.length(line).between(1, 40) & H.ends_with_colon(line) & ~H.is_body(line) & ~H.is_not_heading(line), 2)
    own = F.col("heading_level") > 0
    title = F.col("layout_type") == "paragraph_title"
    numbered = F.coalesce(H.numbering_signal(line) != "section_arabic_spaced", F.lit(False))
    dropped = own & is_ocr & title & right & ~numbered & ~line.rlike("[:：]") & (F.length(line) <= 24)
    kept = F.when(is_ocr & (body_like | H.ends_with_colon(h) | h.rlike(H.CAPTION_PREFIX)), F.lit(None).cast("int")).when(num.isNotNull(), num).when(is_ocr & title & (F.col("heading_level") == 2), F.col("ocr_level")).otherwise(F.col("heading_level"))
    own, dropped = F.coalesce(own, F.lit(False)), F.coalesce(dropped, F.lit(False))
    level = F.when(~open_, F.col("heading_level")).when(own & ~dropped, kept).otherwise(F.coalesce(sidebar, found))
    reason = F.when(~open_ | (own & ~dropped), F.col("heading_reason")).when(sidebar.isNotNull(), "sidebar").when(rejected, "not_apart").otherwise(F.col("heading_reason"))
    e = e.withColumn("level_hint", F.when(dropped, F.col("heading_level")).otherwise(F.col("level_hint"))).withColumn("__level", level.cast("int")).withColumn("heading_reason", reason).withColumn("heading_level", F.col("__level"))
    return d.with_elements(e.select(*d.elements.columns))


def _coherent(numbers, least: int):
    """Whether a sorted array of distinct numbers hardly skips any: gaps of 2 at most, half of the span covered."""
    n = F.size(numbers)
    gaps = F.transform(F.slice(numbers, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, i: x - F.get(numbers, i))
    return (n >= least) & (F.coalesce(F.array_max(gaps), F.lit(0)) <= 2) & (n / (F.element_at(numbers, -1) - F.element_at(numbers, 1) + 1) >= 0.5)


def _weakly_numbered(elements: DataFrame) -> DataFrame:
    """elements with the numbers of ``1 Title`` (__root) and of ``1.2 Title`` (__of, __sub)."""
    h = F.col("__head")
    own = (F.col("type") == "text") & ~flag("toc_entry") & ~flag("toc_header") & (F.length(h) > 0)
    usable = ~H.is_body(h) & ~H.is_not_heading(h) & ~H.ends_with_colon(h)
    # Most texts have no number, and needn't be looked at any further.
    signal = F.when(own, let(H.numbering_signal(h), lambda s: F.when(s.isNotNull() & usable, s)))
    e = computed(computed(elements, __head=H.heading_text(F.col("content"))), __signal=signal)
    signal = F.col("__signal")
    # A number in other digits, or behind a mark, is none here.
    return e.withColumn("__root", F.when(signal == "section_arabic_spaced", F.regexp_extract(h, r"(?U)^(\d{1,3})\s", 1).try_cast("int"))).withColumn("__of", F.when(signal == "section_arabic_nested", F.regexp_extract(h, r"^(\d{1,9})\.\d", 1).try_cast("int"))).withColumn("__sub", F.when(signal == "section_arabic_nested", F.regexp_extract(h, r"^\d+\.(\d{1,9})", 1).try_cast("int")))


def coherent_groups(elements: DataFrame) -> DataFrame:
    """(doc_id, __of, root): coherent numbers of a document, those of its roots (root) or of the parts of one (__of). Elements are gone over once for both."""
    number = F.coalesce("__root", "__sub")
    e = _weakly_numbered(elements).filter(number.isNotNull()).groupBy("doc_id", F.col("__root").isNotNull().alias("__kind"), "__of")
    # A filter by what was grouped by would be pushed below it, and part the two kinds again.
    g = e.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(number)).alias("s"), F.max(F.col("__root").isNotNull()).alias("root"))
    return g.filter((F.col("root") & F.col("n").between(3, COHERENT_MOST) & _coherent(F.col("s"), 3)) | (~F.col("root") & (F.col("n") >= 2) & _coherent(F.col("s"), 2))).select("doc_id", "__of", "root")


def coherent_numbering(d: DocSet, groups: DataFrame | None = None) -> DocSet:
    """Headings of weak numbering by its coherence: three to eight lines ``1 Title`` of a document become level 2, two or more ``1.1 Title`` of a root level 3.

    groups, if given, are coherent_groups() of the elements.
    """
    groups = coherent_groups(d.elements) if groups is None else groups
    roots = groups.filter("root").select("doc_id", F.lit(True).alias("__roots"))
    subs = groups.filter("not root").select("doc_id", "__of", F.lit(True).alias("__subs"))
    e = _weakly_numbered(d.elements).withColumn("__short", H.is_short(F.col("__head"))).drop("__head", "__signal").repartition("doc_id")
    e = e.join(roots, "doc_id", "left").join(subs, ["doc_id", "__of"], "left")
    new = F.when(F.coalesce("heading_level", F.lit(0)) > 0, None).when(~F.col("__short"), None).when(F.col("__roots") & F.col("__root").isNotNull(), 2).when(F.col("__subs") & F.col("__sub").isNotNull(), 3)
    e = e.withColumn("__new", new).withColumn("heading_level", F.coalesce("__new", "heading_level")).withColumn("heading_reason", F.when(F.col("__new").isNotNull(), "coherent").otherwise(F.col("heading_reason")))
    return d.with_elements(e.select(*d.elements.columns))


def fallback_candidates(d: DocSet) -> DataFrame:
    """What rules leave open: short lines with one signal, or with none where fonts aren't known, and 80 characters of the texts around."""
    cand = heading_candidates(font_stats(d.elements)).select(F.col("doc_id").alias("__rd"), F.col("font").alias("__rf"), "heading_rank")
    said = F.when((F.col("type") == "text") & (F.length(py_strip(F.col("content"))) > 0), truncate(F.col("content"), 80))
    h = F.col("__head")
    own = (F.col("type") == "text") & (F.coalesce("heading_level", F.lit(0)) == 0) & ~flag("code_block") & ~flag("toc_entry") & ~flag("retained_identity") & ~F.coalesce(F.col("heading_reason") == "not_apart", F.lit(False))
    open_ = own & (F.length(h) > 0) & H.is_short(h) & ~H.is_body(h) & ~H.is_not_heading(h)
    e = computed(d.elements, __head=H.heading_text(F.col("content")), __said=said)
    e = computed(e, __open=F.coalesce(open_, F.lit(False)))
    # Rows are moved with what others say of them, 80 characters at most, and with their own text if they are open.
    only = lambda c: F.when(F.col("__open"), F.col(c)).alias(c)
    e = e.select("doc_id", "page_number", "seq", "__open", "__said", *(only(c) for c in ("elem_id", "__head", "font", "level_hint")))
    # A frame up to the page's end would be gone over again for each of its rows.
    beside = lambda f: F.coalesce(F.expr(f"{f}(__said) ignore nulls over (partition by doc_id, page_number order by seq)"), F.lit(""))
    e = e.withColumn("prev_text", beside("lag")).withColumn("next_text", beside("lead"))
    e = computed(e.filter("__open"), __signal=H.numbering_signal(h), __num=H.numbering_level(h)).withColumn("__font", F.struct("font.name", "font.size", "font.bold"))
    e = e.join(cand, (F.col("doc_id") == F.col("__rd")) & F.col("__font").eqNullSafe(F.col("__rf")), "left").drop("__rd", "__rf")
    num, signal, size = F.col("__num"), F.col("__signal"), F.coalesce(F.col("font.size"), F.lit(0.0))
    font = F.col("heading_rank").isNotNull()
    none = ~font & num.isNull() & (size <= 0) & (F.length(h) <= 30) & ~H.is_metadata(h) & ~H.ends_with_colon(h)
    one = (font & num.isNull()) | (~font & num.isNotNull() & ~((signal == "section_arabic_root") & (size > 0)))
    return e.filter(none | one).select("doc_id", "page_number", "seq", "elem_id", h.alias("text"), "prev_text", "next_text", F.coalesce("heading_rank", F.lit(0)).alias("font_hint"), F.coalesce(num, F.lit(0)).alias("number_hint"), F.coalesce("level_hint", F.lit(0)).alias("ocr_hint"), none.alias("no_signal"))


def classify_fallback(d: DocSet, ask: Callable[[list[dict]], dict[int, int]], batch: int = FALLBACK_BATCH, density: int = FALLBACK_DENSITY) -> DocSet:
    """Levels that ask() gives fallback candidates, in batches of a document's; a level it gives more than ``density`` of them is dropped as unlikely.

    ask takes [{idx, text, prev_text, next_text, ...}] and returns {idx: level}, 0 for no heading. It runs on executors.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_number", "seq"])
        rows = pdf.to_dict("records")
        levels: list[int | None] = []
        for at in range(0, len(rows), batch):
            some = [{**r, "idx": k} for k, r in enumerate(rows[at : at + batch])]
            said = ask(some)
            for k, r in enumerate(some):
                level = int(said.get(k, 0) or 0)
                hint = r["font_hint"] or r["number_hint"] or r["ocr_hint"]
                levels.append(None if not 1 <= level <= 6 else max(level, hint) if hint else level)
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "elem_id": pdf["elem_id"].to_numpy(), "__said": pd.array(levels, "Int32")})

    said = fallback_candidates(d).groupBy("doc_id").applyInPandas(group, "doc_id long, elem_id string, __said int").filter("__said is not null")
    said = said.withColumn("__n", F.count("*").over(Window.partitionBy("doc_id", "__said"))).filter(F.col("__n") <= density).drop("__n")
    e = d.elements.join(said, ["doc_id", "elem_id"], "left").withColumn("heading_level", F.coalesce("heading_level", "__said")).withColumn("heading_reason", F.when(F.col("__said").isNotNull(), "model").otherwise(F.col("heading_reason")))
    return d.with_elements(e.select(*d.elements.columns))


_BODY_END = tuple("。！？!?.;；")
_ONLY_NUMBER = re.compile(r"\d+(?:\.\d+)*\.?")
_HANGING = re.compile(r"\b(?:with|for|and|the|of|on|or|to|in)$", re.I)
_LABEL = re.compile(r"[A-Za-z一-鿿]{1,12}\s*[:：]\s*.")
_DATE = re.compile(H.DATE.replace("(?U)", ""))
_NUMBERED = re.compile("|".join(r.replace("(?U)", "").removeprefix("^") for _, r, _ in H.NUMBERING))


def _body(t: str) -> bool:
    t = t.strip()
    return len(t) > 100 or t.endswith(_BODY_END)


def _unfinished(t: str) -> bool:
    return t.endswith("-") or bool(_HANGING.search(t))


def _box(e: dict) -> dict:
    return e.get("bbox") or {"x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0}


def merge_cover(rows: list[dict]) -> list[dict]:
    """A first page's headings of level 1 that are pieces of one title, as one: short, close, without numbers, before any body text."""
    live = [r for r in rows if r["type"] == "text" and not r.get("skip_render")]
    for k, r in enumerate(live):
        if r.get("skip_render"):
            continue
        if not r.get("heading_level"):
            if _body(r["content"]):
                break
            continue
        for nxt in live[k + 1 :]:
            a, b, p, q = r["content"].strip(), nxt["content"].strip(), _box(r), _box(nxt)
            fits = r["heading_level"] == nxt.get("heading_level") == 1 and a and b and max(len(a), len(b)) <= 40 and not any(_NUMBERED.match(t) or _body(t) for t in (a, b))
            if not fits or q["y0"] - p["y1"] > max(3 * (p["y1"] - p["y0"]), 80) or p["x0"] > q["x1"] or q["x0"] > p["x1"]:
                break
            r["content"] = a + b
            nxt.update(skip_render=True, skip_reason="merged_heading")
    return rows


def merge_split(rows: list[dict]) -> list[dict]:
    """A page's headings that stop short (a bare number, a hyphen, a function word) with the line of heading type that goes on, in the same place or just below."""
    live = [r for r in rows if r["type"] == "text"]
    for k, r in enumerate(live):
        text = r["content"].strip()
        if not r.get("heading_level") or r.get("skip_render") or not text or not (_ONLY_NUMBER.fullmatch(text) or _unfinished(text)):
            continue
        nxt = next((x for x in live[k + 1 :] if not x.get("skip_render")), None)
        if nxt is None or nxt.get("heading_level") or not nxt.get("__candidate"):
            continue
        more = nxt["content"].strip()
        if not more or len(more) > 80 or "\n" in more or _body(more) or _LABEL.match(more) or _DATE.match(more):
            continue
        p, q = _box(r), _box(nxt)
        same = all(abs(p[c] - q[c]) < 5 for c in p)
        tall, gap = max(p["y1"] - p["y0"], 1.0), q["y0"] - p["y1"]
        if same or -tall <= gap <= 1.2 * tall and min(p["x1"], q["x1"]) > max(p["x0"], q["x0"]):
            r["content"] = text[:-1] + more if text.endswith("-") else f"{text} {more}"
            r["spans"] = None
            nxt.update(skip_render=True, skip_reason="merged_heading")
    return rows


def _subtitle(t: str) -> bool:
    t = t.strip()
    return bool(t) and len(t) <= 80 and not _body(t) and t[0] not in "(（[【" and not _LABEL.match(t) and not _DATE.match(t)


def split_heading(content: str, level: int) -> tuple[list[str], str | None]:
    """(headings, body) of a heading with several lines. Titles of up to three lines, at level 1 or after a colon, are headings each; a number or unfinished line takes up to three lines more."""
    rows = content.split("\n")
    first, n, apart = rows[0].strip(), 1, False
    if len(rows) > 1:
        if _ONLY_NUMBER.fullmatch(first) or _unfinished(first):
            for k in range(1, min(len(rows), 4)):
                s = rows[k].strip()
                if not s or len(s) > 60 or _body(s):
                    break
                n = k + 1
                if not _unfinished(s):
                    break
        elif first and (level == 1 or first.endswith((":", "："))) and _subtitle(rows[1]):
            while n < min(len(rows), 3) and _subtitle(rows[n]):
                n += 1
            apart = n >= 2
    body = "\n".join(rows[n:]) if any(x.strip() for x in rows[n:]) else None
    if apart:
        return [x.strip() for x in rows[:n]], body
    whole = first
    for s in (x.strip() for x in rows[1:n]):
        if s:
            whole = whole[:-1] + s if whole.endswith("-") else f"{whole} {s}" if whole else s
    return [whole], body


def _split_rows(rows: list[dict]) -> list[dict]:
    out = []
    for r in rows:
        if r["type"] != "text" or not r.get("heading_level") or "\n" not in (r["content"] or ""):
            out.append(r)
            continue
        heads, body = split_heading(r["content"], r["heading_level"])
        parts = [(h, r["heading_level"]) for h in heads] + ([(body, None)] if body is not None else [])
        for k, (text, level) in enumerate(parts):
            out.append({**r, "content": text, "heading_level": level, "spans": None if text != r["content"] else r.get("spans"), "seq": r["seq"] + k / 16, "elem_id": r["elem_id"] if not k else f"{r['elem_id']}/{k}"})
    return out


def _page_rules(rows: list[dict]) -> list[dict]:
    if rows and rows[0]["page_number"] == rows[0].get("__first"):
        rows = merge_cover(rows)
    return _split_rows(merge_split(rows))


def heading_shape(d: DocSet) -> DocSet:
    """Headings in several pieces joined, and headings with body text parted, on the pages that have any."""
    cand = heading_candidates(font_stats(d.elements)).select(F.col("doc_id").alias("__rd"), F.col("font").alias("__rf"), F.lit(True).alias("__candidate"))
    on = ["doc_id", "page_number"]
    e = d.elements.repartition("doc_id").withColumn("__f", F.struct("font.name", "font.size", "font.bold"))
    e = e.join(cand, (F.col("doc_id") == F.col("__rd")) & F.col("__f").eqNullSafe(F.col("__rf")), "left").drop("__rd", "__rf", "__f")
    e = e.join(d.pages.groupBy("doc_id").agg(F.min("page_number").alias("__first")), "doc_id", "left")
    # Documents are brought together once; both branches read that.
    headed = F.max(F.col("heading_level") > 0).over(Window.partitionBy(*on))
    e = e.withColumn("__headed", F.coalesce(headed & F.col("doc_id").isNotNull() & F.col("page_number").isNotNull(), F.lit(False)))
    # No rule makes spans where there are none.
    void = void_columns(d.elements)
    shaped = fold(e.filter("__headed").drop("__headed"), tuple(on), _page_rules, columns=("type", "content", "heading_level", "skip_render", "skip_reason", "bbox", "spans", "elem_id", "__candidate", "__first"), together=True, changes=("seq", "content", "heading_level", "skip_render", "skip_reason", "elem_id", *(c for c in ("spans",) if c not in void))).select(*d.elements.columns)
    return d.with_elements(e.filter("not __headed").select(*d.elements.columns).unionByName(shaped))


def title_pairs(d: DocSet) -> DocSet:
    """A recognised document title becomes level 2 where the document's next heading is a subtitle that dashes lead."""
    if "layout_type" in void_columns(d.elements):
        return d
    hs = d.elements.filter("heading_level > 0").withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "seq"))).filter("__k <= 2")
    ocr = lambda kind, level: (F.col("source") == "ocr") & (F.col("layout_type") == kind) & (F.col("heading_level") == level)
    a = hs.filter(ocr("doc_title", 1) & (F.col("__k") == 1)).select("doc_id", "elem_id")
    b = hs.filter(ocr("paragraph_title", 2) & (F.col("__k") == 2) & py_strip(F.col("content")).rlike("^[-–—一]{2,}")).select("doc_id")
    hit = a.join(b, "doc_id", "left_semi").withColumn("__hit", F.lit(True))
    e = d.elements.join(hit, ["doc_id", "elem_id"], "left").withColumn("heading_reason", F.when(F.col("__hit"), "title_pair").otherwise(F.col("heading_reason"))).withColumn("heading_level", F.when(F.col("__hit"), 2).otherwise(F.col("heading_level")))
    return d.with_elements(e.select(*d.elements.columns))


def orphan_clusters(elements: DataFrame) -> DataFrame:
    """(doc_id, level, prefix, n): five or more headings of a level numbered ``prefix.N``, three deep or more, where no heading is numbered prefix."""
    head = H.heading_text(F.col("content"))
    hs = computed(elements.filter("type = 'text' and heading_level > 0"), __head=head)
    hs = computed(hs, number=F.regexp_extract("__head", r"^(\d+(?:\.\d+)+)", 1), __signal=H.numbering_signal(F.col("__head"))).filter((F.length("number") > 0) & (F.col("__signal") == "section_arabic_nested"))
    deep = hs.filter(F.size(F.split("number", r"\.")) >= ORPHAN_DEPTH).withColumn("prefix", F.regexp_replace("number", r"\.\d+\z", ""))
    parents = hs.select("doc_id", F.col("number").alias("prefix")).distinct()
    return deep.join(parents, ["doc_id", "prefix"], "left_anti").groupBy("doc_id", F.col("heading_level").alias("level"), "prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= ORPHANS)


def demote_orphans(d: DocSet, clusters: DataFrame | None = None) -> DocSet:
    """Headings of orphan clusters are lists of terms: they become text. clusters, if given, are orphan_clusters() of the elements."""
    number = F.regexp_extract(H.heading_text(F.col("content")), r"^(\d+(?:\.\d+)+)", 1)
    bad = (orphan_clusters(d.elements) if clusters is None else clusters).select("doc_id", F.col("level").alias("heading_level"), F.col("prefix").alias("__prefix"), F.lit(True).alias("__bad"))
    e = d.elements.withColumn("__prefix", F.when((F.col("type") == "text") & (F.col("heading_level") > 0), F.regexp_replace(number, r"\.\d+\z", "")))
    e = e.join(bad, ["doc_id", "heading_level", "__prefix"], "left").withColumn("heading_reason", F.when(F.col("__bad"), "orphan_cluster").otherwise(F.col("heading_reason"))).withColumn("heading_level", F.when(F.col("__bad"), F.lit(None).cast("int")).otherwise(F.col("heading_level")))
    return d.with_elements(e.select(*d.elements.columns))


def _stored(d: DocSet) -> bool:
    return hasattr(d.elements, "_stored_at")


def _toc_step(d: DocSet) -> DocSet:
    """toc_blocks(), unless written elements have no such header: then they stay as they are, and nothing is moved."""
    return d if _stored(d) and d.elements.filter(_toc_header()).isEmpty() else toc_blocks(d)


def _numbering_step(d: DocSet) -> DocSet:
    """coherent_numbering(), unless nothing is coherent."""
    if not _stored(d):
        return coherent_numbering(d)
    groups = materialise(coherent_groups(d.elements), "numbering")
    return d if groups.isEmpty() else coherent_numbering(d, groups)


def _orphan_step(d: DocSet) -> DocSet:
    """demote_orphans(), unless there are none."""
    if not _stored(d):
        return demote_orphans(d)
    clusters = materialise(orphan_clusters(d.elements), "orphans")
    return d if clusters.isEmpty() else demote_orphans(d, clusters)


def chapters(d: DocSet, ask: Callable[[list[dict]], dict[int, int]] | None = None) -> DocSet:
    """All heading rules in order; ask, if given, decides what they leave open.

    Rules look at a document's elements from several sides, so each one's result is written and read again: plans would else multiply.
    """
    steps = [_toc_step, detect_headings, _numbering_step, *([lambda x: classify_fallback(x, ask)] if ask is not None else []), title_pairs, heading_shape, _orphan_step]
    given = d.elements
    for k, step in enumerate(steps):
        before, d = d.elements, step(d)
        if d.elements is before:
            continue
        if k < len(steps) - 1:
            d = d.with_elements(materialise(d.elements, f"headings-{k}", narrow=True))
            if before is not given:
                discard(before)
    return d


__all__ = ["chapters", "classify_fallback", "coherent_numbering", "default_ocr_level", "demote_orphans", "detect_headings", "fallback_candidates", "heading_shape", "isolated", "mark_toc", "merge_cover", "merge_split", "orphan_clusters", "split_heading", "title_pairs", "toc_blocks"]
