"""Predicates and levels that tell headings, lists, page numbers and captions from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.let import let
from foliospark.functions.text import CJK, SENTENCE_END, WHITE, beyond_ascii, ends_with, first_line, py_strip, replace_where

_CN = "一二三四五六七八九十百千万"
_CN_ALL = _CN + "零〇"
_IDEO = "一-鿿"
#: (signal, regex, level), the first that matches counts.
NUMBERING = (
    ("chapter_cn", f"^第[0-9{_CN}]+[章节编部分]", 1),
    ("article_cn", f"^第[0-9{_CN_ALL}]+条", 3),
    ("appendix_cn", f"^附[录件][0-9{_CN_ALL}]+", 2),
    ("section_cn", f"^[{_CN}]+[.)、．]", 2),
    ("section_cn_paren", f"^[(（][{_CN}]+[)）]", 2),
    ("section_arabic_nested", rf"(?U)^\d+(?:\.\d+)+(?:[.)、．\s]|(?=[{_IDEO}]))", 3),
    ("section_arabic_paren", r"^[(（]?\d+[)）]", 3),
    ("section_arabic_ideograph", rf"^\d{{1,3}}、[A-Za-z{_IDEO}]", 2),
    ("section_arabic_spaced", rf"(?U)^\d{{1,3}}\s+[A-Za-z{_IDEO}]", 2),
    ("section_arabic_root", rf"(?U)^\d+\.\s*[A-Za-z{_IDEO}]", 2),
)
#: What all of them begin with; a single character is far cheaper to look at than a text for each pattern.
_OPENS = rf"(?U)[\d第附(（{_CN}]"
STRONG = ("chapter_cn", "section_cn", "section_cn_paren")
STRONG_WITH_COLON = ("chapter_cn", "article_cn", "appendix_cn")
DATE = r"(?U)^\d{4}\s*(?:年|[-/.]\s*\d{1,2}\s*[-/.月])"
LEADERS = r"\.{3,}|…{2,}"
FIELD = rf"(?U)^[A-Za-z{_IDEO}]{{1,12}}\s*[:：]\s*."
PRICE = r"(?U)^[€£¥$₽]\s*[,\d]+(?:\.\d+)?\z"
NAV = r"(?U)[>»›]\s*\z"
CAPTION_PREFIX = r"(?iU)^#{0,6}\s*(?:table|tab\.|figure|fig\.|表|图)\s*\d"
TOC_TAIL = r"(?U)(?:\.{2,}|-{2,}|—+|…+|\s)\d{1,4}\s*\z"
TOC_NAMES = ("contents", "table of content", "table of contents", "目录", "目 录", "目　录")
LIST_MARKER = rf"(?U)^\s*(?:[*•·●○■□▪▸▹-]|(?:[A-Za-z]|\d+)[.、)]|[{_CN}]+[.、]|第[0-9{_CN}]+[章节编条款项目]|[(（](?:[A-Za-z{_CN}]+|\d+)[)）]|\[\d{{1,6}}\])\s*"


def _unmarked(text: Column) -> Column:
    """Without heading marks and emphasis, full-width digits and stop as ASCII."""
    t = replace_where(py_strip(text), "#", r"(?U)^\s{0,3}#{1,6}\s*", "")
    return let(F.replace(t, F.lit("*"), F.lit("")), lambda u: F.when(beyond_ascii(u), F.translate(u, "．０１２３４５６７８９", ".0123456789")).otherwise(u))


def _signal(t: Column) -> Column:
    out = None
    for name, regex, _ in NUMBERING:
        out = F.when(t.rlike(regex), name) if out is None else out.when(t.rlike(regex), name)
    return F.when(F.left(t, F.lit(1)).rlike(_OPENS), out)


def numbering_signal(text: Column) -> Column:
    """The name of the numbering a text begins with; null for none."""
    return let(_unmarked(text), _signal)


def _level(t: Column, signal: Column) -> Column:
    depth = F.size(F.split(F.regexp_extract(t, r"^(\d+(?:\.\d+)+)", 1), r"\."))
    out = F.when(signal == "section_arabic_nested", F.least(depth + 1, F.lit(6)))
    for name, _, level in NUMBERING:
        out = out.when(signal == name, F.lit(level))
    return out


def numbering_level(text: Column) -> Column:
    """The level numbering stands for; that of nested arabic numbers is a level below their depth, six at most."""
    return let(_unmarked(text), lambda t: let(_signal(t), lambda s: _level(t, s)))


def heading_text(content: Column) -> Column:
    """The first line; a bare number joined with the short line that follows, if it isn't body text."""

    def joined(first: Column, following: Column) -> Column:
        both = F.concat(first, F.lit(" "), following)
        return F.when(following.isNotNull() & ~is_body(following) & (F.length(both) <= 80), both).otherwise(first)

    rest = F.filter(F.transform(F.slice(F.split(content, "\n"), 2, 2), py_strip), lambda x: F.length(x) > 0)
    return let(first_line(content), lambda first: F.when((F.length(first) < 80) & first.rlike(r"(?U)^\d+\z"), let(F.get(rest, F.lit(0)), lambda f: joined(first, f))).otherwise(first))


def is_body(text: Column) -> Column:
    return let(py_strip(text), lambda t: (F.length(t) > 100) | ends_with(t, SENTENCE_END.strip("[]")))


def is_not_heading(text: Column) -> Column:
    """What numbering or type alone would take for a heading: dates, entries of a table of contents, prices, links, captions."""
    return let(py_strip(text), lambda t: t.rlike(DATE) | t.rlike(LEADERS) | t.rlike(r"(?U)^\d+\z") | t.rlike(PRICE) | t.rlike(NAV) | t.rlike(CAPTION_PREFIX) | (F.length(t) <= 1))


def is_metadata(text: Column) -> Column:
    return let(py_strip(text), lambda t: t.rlike(FIELD) | t.rlike(DATE))


def is_short(text: Column) -> Column:
    return let(py_strip(text), lambda t: (F.instr(t, "\n") == 0) & (F.length(t) <= 80))


def ends_with_colon(text: Column) -> Column:
    return ends_with(py_strip(text), ":：")


def is_list_item(text: Column) -> Column:
    return text.rlike(LIST_MARKER)


def is_toc_header(text: Column) -> Column:
    return F.lower(py_strip(text)).isin(*TOC_NAMES)


def is_page_number(text: Column) -> Column:
    return let(py_strip(text), _page_number)


def _page_number(t: Column) -> Column:
    return t.rlike(r"(?U)^[—\s-]*\d{1,5}[—\s-]*\z") | t.rlike(r"(?iU)^[—\s-]*[cdilmvx]+[—\s-]*\z") | t.rlike(r"(?U)^[-–—]\s*\d+\s*[-–—]\z") | t.rlike(r"(?U)^第\s*\d+\s*页\z")


def running_text(text: Column) -> Column:
    """With numbers as ``#``, so that headers that only count pages are the same."""
    return F.regexp_replace(py_strip(text), r"(?U)\d+", "#")


_MONO = "andale consolas courier dejavusans+mono droidsans+mono firacode firamono ibmplex+mono inconsolata jetbrains+mono liberation+mono lucida+console menlo monaco monospace nimbus+mon notosans+mono roboto+mono sf+mono source+code+pro ubuntu+mono"
MONO = "(?iU)" + "|".join(["hack(?!ney)", r"\b(?:fixed|mono)\b", *(w.replace("+", r"\s*").replace("sans", r"\s*sans\s*").replace("firacode", r"fira\s*code").replace("firamono", r"fira\s*mono").replace("ibmplex", r"ibm\s*plex") for w in _MONO.split())])
NOT_CODE = rf"(?U)^\s*(?:[{CJK}]|(?:[IVXivx]+|\d+)[.、)]\s|[A-Za-z][.)]\s)"


def is_monospace(font_name: Column) -> Column:
    return F.coalesce(font_name, F.lit("")).rlike(MONO)


_LABELS = {"figure": r"(?:figure|fig\.?|图表|图)", "table": r"(?:table|表)"}
_NUMBER = r"[A-Za-z0-9零〇一二三四五六七八九十百千万两().\-]+"
_SEPARATOR = r"[:：.\-]"


def caption_kind(text: Column) -> Column:
    """``figure`` or ``table`` for a caption of 160 characters at most: a label with a number and a title, or with a separator and a short title."""
    out = None
    for kind, label in _LABELS.items():
        numbered = text.rlike(rf"(?iU)^\s*{label}\s*{_NUMBER}\s*(?:{_SEPARATOR}\s*|\s+)\S.*\z")
        title = py_strip(F.regexp_extract(text, rf"(?iUs)^\s*{label}\s*{_SEPARATOR}\s*(.+)\z", 1))
        hit = numbered | F.length(title).between(2, 60)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    # What labels begin with.
    return F.when((F.length(text) <= 160) & F.left(F.ltrim(text, F.lit(WHITE)), F.lit(1)).isin(*"FfTt图表"), out)


_WARNINGS = (
    ("number_mismatch", "number mismatch"),
    ("low_confidence_vlm", "low-confidence vlm description"),
    ("image_missing_reference", "image output missing rendered reference"),
    ("text_volume_drift", "rendered text volume drifted beyond tolerance"),
    ("table_count_mismatch", "table count mismatch"),
    ("page_marker_mismatch", "page marker mismatch"),
    ("heading_level_jump", r"jump from h\d+ to h\d+"),
    ("orphan_heading", r"orphan h\d+"),
    ("empty_heading", "empty heading"),
    ("empty_chapter_file", "chapter file is empty"),
    ("placeholder_leakage", "placeholder/debug text detected"),
    ("html_table_leakage", "html table markup detected"),
    ("image_asset_orphan", r"image (?:reference .+ not found|file .+ not referenced)"),
    ("duplicate_body_text", "image description duplicates .+ body text"),
)
_WARNING_LABELS = {"low_confidence_vlm": "Low-confidence VLM", "html_table_leakage": "HTML table leakage"}


def warning_code(text: Column) -> Column:
    """The category of a warning; ``other`` if none fits."""
    t, out = F.lower(text), None
    for code, regex in _WARNINGS:
        out = F.when(t.rlike(regex), code) if out is None else out.when(t.rlike(regex), code)
    return out.otherwise("other")


def warning_label(code: Column) -> Column:
    words = F.replace(code, F.lit("_"), F.lit(" "))
    out = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000))
    for c, label in _WARNING_LABELS.items():
        out = F.when(code == c, label).otherwise(out)
    return out
