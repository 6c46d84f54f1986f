"""Broken notation put right by a vision model, one candidate at a time.

Which texts deserve it, and what in them, is decided here; the model sees the page and the place, and what it answers is taken only if it
stays near what it replaces and doesn't flatten it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import for_comparison
from foliospark.model import DocSet
from foliospark.operators.formula import INDICATORS, normalize_formulas
from foliospark.sources.files import parse_json

MOST, MAX_CHARS, SURE = 6, 1200, 0.95
_SMALL = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"
_COMMAND = re.compile(r"\\[A-Za-z]+")
_INLINE = re.compile(r"\$[^\n$]{1,120}\$")
_SCRIPT = re.compile(r"[A-Za-z]{1,12}\s*[_^]\s*(?:\{[^{}\n]{1,20}\}|\w{1,4})")
_CHARGED = re.compile(r"\b(?:[A-Z][a-z]?\d{0,3}){1,8}\s?\d?[+-](?![\w])")
_MIXED = re.compile(r"\b[A-Za-z]{1,3}\d+[A-Za-z0-9+-]*\b")
_OPERATED = re.compile(r"\b[A-Za-z0-9]{1,20}(?:[_^=+/-][A-Za-z0-9{}()]{1,30}){1,4}")
_UNICODE = re.compile(rf"[A-Za-z0-9()\[\]]*[{_SMALL}][A-Za-z0-9()\[\]{_SMALL}]*(?:[+-](?!\w))?")
_KINDS = (_INLINE, _SCRIPT, _UNICODE, _CHARGED, _MIXED, _OPERATED)
_REFUSES = re.compile(r"\b(?:i'?m sorry|i am sorry|cannot|can't|unable to|as an ai|not visible|unclear)\b|无法|抱歉", re.I)
PROMPT = "A scanned page reads:\n{text}\n\nLook at the region {box} of the image, in points. Is this piece of notation right as it was read?\n{candidate}\n\nAnswer with one JSON object: confidence (high, medium or low), change_kind (ocr_fix where it was misread, format_only where only its style differs, none) and replacement_text, for that piece alone, in standard notation; empty if the image doesn't settle it."


def structure(text: str) -> int:
    """How much a text is written as notation."""
    marks = ("$" in text, _COMMAND.search(text), any(c in _SMALL for c in text), "_{" in text or "^{" in text)
    return 2 * sum(map(bool, marks)) + any(c in "[]{}" for c in text) + bool(re.search(r"(?<=\S)[+-](?=\S)", text))


def signal(text: str) -> int:
    """How much a text looks like notation that recognition may have broken; 3 is worth a look, 2 where it was unsure."""
    if not text.strip():
        return 0
    hits = 3 * bool(re.search(INDICATORS, text)) + 2 * bool(_COMMAND.search(text)) + 2 * ("$" in text) + 2 * bool(_SCRIPT.search(text)) + 2 * bool(_MIXED.search(text))
    return hits + (bool(re.search("[A-Za-z]", text)) and bool(re.search(r"\d", text)) and len(re.findall(r"[_^=+/-]", text)) >= 2)


def candidates(text: str) -> list[str]:
    """The pieces of a text that look like notation, none within another: the likeliest first, of equals the shortest."""
    found = {m[0].strip() for kind in _KINDS for m in kind.finditer(text)} - {""}
    kept: list[str] = []
    for c in sorted(found, key=lambda c: (-len(c), c)):
        plain = _OPERATED.fullmatch(c) and not any(k.fullmatch(c) for k in _KINDS[:-1])
        enough = not plain or len(re.findall(r"[_^=+/-]", c)) >= 2 and re.search("[A-Za-z]", c) and re.search(r"\d", c)
        if enough and not any(c in k for k in kept):
            kept.append(c)
    rank = lambda c: -(signal(c) + 2 * ("$" in c) + 2 * any(x in _SMALL for x in c) + 3 * bool(_CHARGED.fullmatch(c)))
    return sorted(kept, key=lambda c: (rank(c), len(c), c))


def place_of(box: dict, text: str, candidate: str) -> dict:
    """About where a piece of an element's text is, with room around it: lines share the height, and their characters the width."""
    at = text.find(candidate)
    if at < 0:
        return box
    rows = text.split("\n")
    row = text.count("\n", 0, at)
    start = at - (text.rfind("\n", 0, at) + 1)
    wide, tall = max(box["x1"] - box["x0"], 1.0), max(box["y1"] - box["y0"], 1.0) / len(rows)
    n = max(len(rows[row]), 1)
    left, right = box["x0"] + wide * start / n, box["x0"] + wide * min((start + len(candidate)) / n, 1.0)
    top = box["y0"] + tall * row
    dx, dy = max(0.35 * (right - left), 8.0), max(0.35 * tall, 6.0)
    return {"x0": max(box["x0"], left - dx), "y0": max(box["y0"], top - dy), "x1": min(box["x1"], right + dx), "y1": min(box["y1"], top + tall + dy)}


def _distance(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def acceptable(old: str, new: str) -> bool:
    """Whether new may take old's place: it says something, is of a like length, differs by three quarters at most, and is still notation if old was. Blanks inside dollars may always go."""
    new = new.strip()
    if not new or _REFUSES.search(new):
        return False
    tight = lambda s: re.sub(r"\s*\$\s*", "$", s).strip()
    if tight(old) == tight(new):
        return True
    a, b = " ".join(old.split()), " ".join(new.split())
    if not max(4, len(a) // 4) <= len(b) <= 3 * max(len(a), 1) or _distance(a, b) > 0.75:
        return False
    most = lambda s: max(structure(s), structure(normalize_formulas(s)))
    return most(old) < 2 or most(new) > 0


def corrected(text: str, candidate: str, answer: str | None) -> str | None:
    """text with what a model's answer puts in the candidate's place, normalised; None if the answer is unsure, changes form alone, or isn't acceptable."""
    said = parse_json(answer)
    if not isinstance(said, dict):
        return None
    word = lambda k: str(said.get(k) or "").strip()
    new = word("replacement_text")
    if word("confidence").lower() == "low" or word("change_kind").lower() in ("", "none", "format_only") or candidate not in text or new == candidate or not acceptable(candidate, new):
        return None
    return normalize_formulas(text.replace(candidate, new, 1))


def correct_formulas(d: DocSet, images: DataFrame, ask: Callable[[bytes, str], str], most: int = MOST, max_chars: int = MAX_CHARS) -> DocSet:
    """Recognised texts with their notation corrected by ask(page image, prompt), ``most`` questions to a document; those of a failed call stay.

    images are rendered pages (doc_id, page_number, image). Texts are those before :func:`foliospark.operators.formula.formulas`. A page is shown once
    for each of its texts that are asked about, and a text's questions end with the first correction.
    """
    on = ["doc_id", "page_number"]
    n = F.length(for_comparison(F.col("content")))
    score = F.udf(lambda t, sure: max(signal(t), signal(normalize_formulas(t))) >= (3 if sure is None or sure >= SURE else 2), "boolean")
    e = d.elements.filter((F.col("source") == "ocr") & (F.col("type") == "text") & F.col("bbox").isNotNull() & n.between(1, max_chars) & (F.col("content").rlike(r"[A-Za-z]\d|[$\\_^]") | F.col("content").rlike(INDICATORS)))
    e = e.filter(score("content", "confidence")).select(*on, "seq", "elem_id", "content", "bbox", F.udf(candidates, "array<string>")("content").alias("pieces")).filter(F.size("pieces") > 0)
    # As many questions as are left when those before have had theirs.
    w = Window.partitionBy("doc_id").orderBy("page_number", "seq")
    e = e.withColumn("__before", F.coalesce(F.sum(F.size("pieces")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("__before") < most)
    e = e.withColumn("pieces", F.slice("pieces", F.lit(1), (F.lit(most) - F.col("__before")).cast("int"))).join(images.select(*on, "image"), on)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                new = None
                for piece in r.pieces:
                    box = {k: round(v, 1) for k, v in place_of(dict(r.bbox) if isinstance(r.bbox, dict) else r.bbox.asDict(), r.content, piece).items()}
                    try:
                        answer = ask(bytes(r.image), PROMPT.format(text=r.content, box=box, candidate=piece))
                    except Exception:
                        # A call that failed leaves its text as it is.
                        continue
                    new = corrected(r.content, piece, answer)
                    if new is not None:
                        break
                out.append(new)
            yield pdf[["doc_id", "elem_id"]].assign(__new=pd.Series(out, dtype=object, index=pdf.index))

    found = e.mapInPandas(run, "doc_id long, elem_id string, __new string").filter("__new is not null")
    joined = d.elements.join(found, ["doc_id", "elem_id"], "left")
    return d.with_elements(joined.withColumn("spans", F.when(F.col("__new").isNull(), F.col("spans"))).withColumn("content", F.coalesce("__new", "content")).select(*d.elements.columns))
