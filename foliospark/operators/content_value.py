"""What a block is worth apart from its page: interface shells and decoration go.

A block's score reads its neighbours that are still there, and suppressing one changes what the next sees, so pages are folds; the
statistics of a page come from windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import SENTENCE_END, compact, ends_with, text_len
from foliospark.model import PLACE, DocSet, flag
from foliospark.operators.fold import fold

THRESHOLD, GRAY, SMALL = 0.25, 0.1, 180
_END = tuple("。！？!?；;.")
_ITEM = re.compile(r"[-*•]\s+|\d+[.)、]\s+")
_SYMBOLS = re.compile(r"[\W_]+")
_LABEL = re.compile(r"[A-Za-z一-鿿]{1,12}\s*[:：]\s*.+")
_DATE = re.compile(r"\d{4}[-./年]\s*\d{1,2}[-./月](?:\s*\d{1,2}日?)?")
_NAME = re.compile("[一-鿿]{2,6}")


def body_band(d: DocSet) -> DataFrame:
    """(doc_id, page_number, body_left, body_right): the quarter of x0 and the three quarters of x1 of a page's body texts, weighted by length."""
    e = d.elements.filter((F.col("type") == "text") & ~flag("skip_render") & (F.coalesce("heading_level", F.lit(0)) == 0)).withColumn("n", text_len(F.col("content")))
    e = e.filter((F.col("n") >= 24) | ends_with(compact(F.col("content")), SENTENCE_END.strip("[]"))).select("doc_id", "page_number", F.coalesce(F.col("bbox.x0"), F.lit(0.0)).alias("x0"), F.coalesce(F.col("bbox.x1"), F.lit(0.0)).alias("x1"), F.greatest("n", F.lit(1)).alias("w"))
    on = ["doc_id", "page_number"]
    total = F.sum("w").over(Window.partitionBy(*on))

    def at(column, q):
        run = F.sum("w").over(Window.partitionBy(*on).orderBy(column).rangeBetween(Window.unboundedPreceding, 0))
        return F.when(run >= total * q, F.col(column))

    return e.withColumn("l", at("x0", 0.25)).withColumn("r", at("x1", 0.75)).groupBy(*on).agg(F.min("l").alias("body_left"), F.min("r").alias("body_right"))


def repeated_assets(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, xref, n): small images that a page shows twice or more."""
    b = F.col("bbox")
    small = (F.coalesce(b.x1 - b.x0, F.lit(0.0)) <= SMALL) & (F.coalesce(b.y1 - b.y0, F.lit(0.0)) <= SMALL)
    return elements.filter((F.col("type") == "image") & (F.col("xref") > 0) & small).groupBy("doc_id", "page_number", "xref").agg(F.count("*").alias("n")).filter("n >= 2")


def _text(e: dict) -> str:
    return " ".join(s for x in (e["content"] or "").splitlines() if (s := x.strip()))


def _b(e: dict) -> tuple[float, float, float, float]:
    b = e.get("bbox")
    return (b["x0"], b["y0"], b["x1"], b["y1"]) if b else (0.0, 0.0, 0.0, 0.0)


#: What scoring reads and writes.
_READ = ("type", "content", "bbox", "heading_level", "caption", "source", "skip_render", "skip_reason", "value_score", "value_reason", "skipped", "needs_vlm", "text_heavy", "description", "evidence_text", "__pw", "__ph", "__left", "__right", "__twice")
_WRITTEN = ("skip_render", "skip_reason", "value_score", "value_reason", "skipped", "needs_vlm")


class _Page:
    def __init__(self, rows: list[dict]):
        self.rows = rows
        first = rows[0]
        self.width, self.height, self.number = first.get("__pw") or 0.0, first.get("__ph") or 0.0, first["page_number"]
        self.left = first["__left"] if first.get("__left") is not None else 0.0
        self.right = first["__right"] if first.get("__right") is not None else self.width

        # Neighbours ask for each other's texts and boxes again and again.
        self.text = [_text(r) if r["type"] == "text" else "" for r in rows]
        self.box = [_b(r) for r in rows]
        # Texts in sight know the ones before and after them, and leave the chain when they are dropped.
        self.chain: dict[int, list[int | None]] = {}
        before = None
        for k, r in enumerate(rows):
            if r["type"] == "text" and not r.get("skip_render"):
                self.chain[k] = [before, None]
                if before is not None:
                    self.chain[before][1] = k
                before = k
        self.images = np.array([b for b, r in zip(self.box, rows, strict=True) if r["type"] == "image"], np.float64).reshape(-1, 4).T

    def near(self, k: int, step: int) -> int | None:
        return self.chain[k][step > 0]

    def drop(self, k: int) -> None:
        before, after = self.chain.pop(k)
        if before is not None:
            self.chain[before][1] = after
        if after is not None:
            self.chain[after][0] = before

    def share(self, k: int) -> float:
        x0, _, x1, _ = self.box[k]
        return max(0.0, min(x1, self.right) - max(x0, self.left)) / max(x1 - x0, 1.0)

    def gap(self, k: int, j: int) -> float:
        p, q = self.box[k], self.box[j]
        return max(q[1] - p[3], p[1] - q[3], 0.0)

    def images_near(self, k: int) -> bool:
        if self.images.shape[1] < 2:
            return False
        x0, y0, x1, y1 = self.box[k]
        a0, b0, a1, b1 = self.images
        close = (np.abs(b0 - y1) <= 80) | (np.abs(y0 - b1) <= 80) | (np.abs((b0 + b1 - y0 - y1) / 2) <= 80)
        return int((close | (np.minimum(a1, x1) - np.maximum(a0, x0) >= 40)).sum()) >= 2

    def signature(self, k: int, text: str) -> bool:
        before, after = self.near(k, -1), self.near(k, 1)
        if not text or len(text) > 20 or before is None or after is not None and len(self.text[after]) > 20:
            return False
        prior = self.text[before]
        if len(prior) < 24:
            earlier = self.near(before, -1) if _NAME.fullmatch(prior) else None
            if earlier is None or len(self.text[earlier]) < 24:
                return False
        return bool(_DATE.fullmatch(text) or _NAME.fullmatch(text))

    def list_item(self, k: int, text: str) -> bool:
        if len(text) > 40 or self.share(k) < 0.5:
            return False
        before, after = self.near(k, -1), self.near(k, 1)
        if before is not None and self.text[before].endswith((":", "：")) and self.gap(before, k) <= 70:
            return True
        siblings = [n for n in (before, after) if n is not None and len(self.text[n]) <= 40 and self.gap(k, n) <= 70 and abs(self.box[n][0] - self.box[k][0]) <= 80]
        return bool(siblings) and any(c in text for c in "(（、:：")

    def score(self, k: int) -> tuple[float, list[str]]:
        """Points and their reasons; the order of additions is fixed, so that sums are the same everywhere."""
        e = self.rows[k]
        text = self.text[k]
        if not text:
            return 0.0, ["empty_text"]
        if e.get("heading_level") or e.get("caption"):
            return 1.0, ["structure_anchor"]
        if _ITEM.match(text):
            return 0.8, ["list_item"]
        n, raw = len(text), [x for x in (e["content"] or "").splitlines() if x.strip()]
        count = len(raw) or 1
        x0, y0, x1, y1 = self.box[k]
        width = max(x1 - x0, 1.0)
        inside, ocr = self.share(k) >= 0.55, e.get("source") == "ocr"
        top, bottom = bool(self.height) and y0 <= 0.1 * self.height, bool(self.height) and y1 >= 0.9 * self.height
        side = bool(self.width) and (x0 <= 0.08 * self.width or x1 >= 0.92 * self.width)
        item, signed, label = self.list_item(k, text), self.signature(k, text), bool(_LABEL.fullmatch(text))
        around = [j for j in (self.near(k, -1), self.near(k, 1)) if j is not None]
        after = self.near(k, 1)
        points: list[tuple[float, str]] = []
        add = lambda on, value, why: points.append((value, why)) if on else None
        add(n >= 24, 0.35, "content_dense")
        add(text.endswith(_END), 0.18, "sentence_like")
        add(self.number == 1 and top and inside and not label and not text.endswith(_END) and 6 <= n <= 28, 0.65, "cover_title")
        add(self.number == 1 and top and label, 0.4, "cover_metadata")
        add(text.endswith((":", "：")), 0.14, "prompt_anchor")
        add(inside, 0.22, "body_column")
        add(ocr, 0.25, "ocr_content")
        add(any(len(self.text[a]) >= 18 and self.share(a) >= 0.5 and self.gap(k, a) <= 70 for a in around), 0.18, "body_continuity")
        add(signed, 0.35, "closing_signature")
        add(item, 0.28, "compact_list_item")
        add(n <= 16 and n / width < 0.09 and not ocr, -0.08 if item or signed else -0.10 if inside else -0.32, "sparse_short_text")
        add(not ocr and count >= 2 and n <= 24 and n / count <= 8, -0.22, "multi_short_lines")
        add(not ocr and (top or bottom), -0.18, "edge_band")
        add(not ocr and side, -0.12, "side_edge")
        add(width >= 0.75 * self.width and n <= 20, -0.22, "wide_sparse_banner")
        add(n <= 24 and self.images_near(k), -0.1 if item else -0.25, "image_cluster")
        add(bool(_SYMBOLS.fullmatch(text)) or n <= 1, -0.4, "symbol_only")
        anchors = after is not None and len(self.text[after]) >= 24 and self.share(after) >= 0.5 and self.gap(k, after) <= 50
        add(n <= 12 and count == 1 and inside and anchors, 0.4, "short_section_anchor")
        total = 0.0
        for value, _ in points:
            total += value
        return total, [why for _, why in points]


def needed(elements: DataFrame) -> list[str]:
    """The columns of elements that content_value() reads or writes."""
    return [c for c in elements.columns if c in {"doc_id", *PLACE, "xref", *_READ}]


def score_page(rows: list[dict], threshold: float = THRESHOLD, gray: float = GRAY, ask: Callable[[str, str], bool] | None = None) -> list[dict]:
    """A page's rows scored; texts and images below the threshold aren't rendered. ask, if given, decides on the texts just above it."""
    page = _Page(rows)
    for k, e in enumerate(rows):
        if e.get("skip_render"):
            continue
        if e["type"] == "text":
            score, why = page.score(k)
            e["value_score"], e["value_reason"] = round(score, 3), ",".join(why) or "body_text"
            if score < threshold or score < threshold + gray and ask is not None and not ask(page.text[k], e["value_reason"]):
                e.update(skip_render=True, skip_reason="low_value")
                page.drop(k)
        elif e["type"] == "image":
            x0, y0, x1, y1 = page.box[k]
            if e.get("skipped"):
                score, reason = 0.0, "already_skipped"
            elif e.get("caption"):
                score, reason = 0.8, "captioned_image"
            elif e.get("text_heavy"):
                score, reason = 0.85, "text_evidence_image"
            elif e.get("description") or e.get("evidence_text"):
                score, reason = 0.7, "described_or_evidence_image"
            elif e.get("__twice") and x1 - x0 <= SMALL and y1 - y0 <= SMALL:
                score, reason = 0.05, "repeated_small_asset"
            else:
                score, reason = 0.5, "default_image"
            e["value_score"], e["value_reason"] = score, reason
            if score < threshold:
                e.update(skip_render=True, skipped=True, needs_vlm=False, skip_reason="low_value")
    return rows


def content_value(d: DocSet, threshold: float = THRESHOLD, gray: float = GRAY, ask: Callable[[str, str], bool] | None = None) -> DocSet:
    on = ["doc_id", "page_number"]
    page = d.pages.select(*on, F.col("width").alias("__pw"), F.col("height").alias("__ph"))
    band = body_band(d).withColumnsRenamed({"body_left": "__left", "body_right": "__right"})
    twice = repeated_assets(d.elements).select(*on, "xref", F.lit(True).alias("__twice"))
    e = d.elements.join(page, on, "left").join(band, on, "left").join(twice, [*on, "xref"], "left")
    return d.with_elements(fold(e, tuple(on), lambda rows: score_page(rows, threshold, gray, ask), columns=_READ, changes=_WRITTEN).select(*d.elements.columns))
