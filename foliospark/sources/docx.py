"""Word documents with the standard library alone: they are XML in a ZIP archive.

Paragraphs become text elements with the heading level of their style and a span for each stretch of one format, tables Markdown, drawings image
elements. Pages are those of the last time the file was laid out, as far as it says so. There are no boxes.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACES = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "m": "http://schemas.openxmlformats.org/officeDocument/2006/math", "v": "urn:schemas-microsoft-com:vml"}
_HEADING = re.compile(r"(?:heading|标题|überschrift|titre|título)\s*(\d)", re.I)
_NUMERIC = re.compile(r"[\d\s]+")
#: Of an inch there are 914400 units, and 96 pixels.
_UNITS = 9525
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf", "svg": "image/svg+xml"}
#: Kinds that only a renderer makes pixels of.
VECTORS = frozenset({"image/x-emf", "image/x-wmf", "image/svg+xml"})
_FORMAT = ("bold", "italic", "underline", "sup")


def _q(name: str) -> str:
    space, _, local = name.partition(":")
    return f"{{{_SPACES[space]}}}{local}"


def _on(properties, name: str) -> bool:
    found = None if properties is None else properties.find(_q(name))
    return found is not None and found.get(_q("w:val"), "true") not in ("0", "false", "none", "off")


def _xml(archive: zipfile.ZipFile, name: str):
    if name not in archive.namelist():
        return None
    raw = archive.read(name)
    # Office writes none, and entities in one could grow without bound.
    if b"<!DOCTYPE" in raw:
        raise ValueError(f"{name} has a document type declaration")
    return ElementTree.fromstring(raw)


class Package:
    """A document's parts: styles, relations and pictures."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.body = _xml(self.archive, "word/document.xml").find(_q("w:body"))
        self.styles: dict[str, ElementTree.Element] = {}
        styles = _xml(self.archive, "word/styles.xml")
        for s in () if styles is None else styles.iter(_q("w:style")):
            self.styles[s.get(_q("w:styleId"), "")] = s
        self.targets: dict[str, str] = {}
        relations = _xml(self.archive, "word/_rels/document.xml.rels")
        for r in () if relations is None else relations:
            if r.get("TargetMode") != "External":
                self.targets[r.get("Id")] = posixpath.normpath(posixpath.join("word", r.get("Target", ""))) if not r.get("Target", "").startswith("/") else r.get("Target")[1:]

    def chain(self, paragraph) -> Iterator[ElementTree.Element]:
        """The properties of a paragraph and of the styles it goes back to, the nearest first, with each style's name."""
        own = paragraph.find(_q("w:pPr"))
        yield own, ""
        style = None if own is None else own.find(_q("w:pStyle"))
        seen, name = set(), None if style is None else style.get(_q("w:val"))
        while name in self.styles and name not in seen:
            seen.add(name)
            s = self.styles[name]
            title = s.find(_q("w:name"))
            yield s.find(_q("w:pPr")), "" if title is None else title.get(_q("w:val"), "")
            based = s.find(_q("w:basedOn"))
            name = None if based is None else based.get(_q("w:val"))

    def level(self, paragraph) -> int | None:
        for properties, name in self.chain(paragraph):
            if m := _HEADING.match(name):
                return int(m[1]) or None
            if name.lower() == "title":
                return 1
            outline = None if properties is None else properties.find(_q("w:outlineLvl"))
            if outline is not None and outline.get(_q("w:val"), "").isdigit():
                return int(outline.get(_q("w:val"))) + 1 if int(outline.get(_q("w:val"))) < 9 else None
        return None

    def in_list(self, paragraph) -> bool:
        for properties, name in self.chain(paragraph):
            number = None if properties is None else properties.find(f"{_q('w:numPr')}/{_q('w:numId')}")
            if number is not None:
                return number.get(_q("w:val")) != "0"
            if name.lower().startswith("list"):
                return True
        return False

    def pictures(self, node) -> Iterator[dict]:
        """Pictures within a node: (target, width, height, rotation)."""
        for drawing in node.iter(_q("w:drawing")):
            extent = next(drawing.iter(_q("wp:extent")), None)
            turned = next(drawing.iter(_q("a:xfrm")), None)
            for blip in drawing.iter(_q("a:blip")):
                size = [0 if extent is None else int(extent.get(k, "0")) // _UNITS for k in ("cx", "cy")]
                yield {"target": self.targets.get(blip.get(_q("r:embed"), ""), ""), "width": float(size[0]), "height": float(size[1]), "rotation": 0.0 if turned is None else int(turned.get("rot", "0")) / 60000}
        for old in node.iter(_q("v:imagedata")):
            yield {"target": self.targets.get(old.get(_q("r:id"), ""), ""), "width": 0.0, "height": 0.0, "rotation": 0.0}


def _pieces(node) -> Iterator[tuple[str, dict]]:
    """("text", span), ("page", {}) and ("pictures", node) of a paragraph, in order; deleted text is left out."""
    for child in node:
        tag = child.tag
        if tag == _q("w:r"):
            p = child.find(_q("w:rPr"))
            raised = None if p is None else p.find(_q("w:vertAlign"))
            form = {"bold": _on(p, "w:b"), "italic": _on(p, "w:i"), "underline": _on(p, "w:u"), "sup": raised is not None and raised.get(_q("w:val")) == "superscript"}
            for part in child:
                if part.tag == _q("w:t"):
                    yield "text", {"text": part.text or "", **form}
                elif part.tag in (_q("w:tab"), _q("w:noBreakHyphen")):
                    yield "text", {"text": "\t" if part.tag == _q("w:tab") else "-", **form}
                elif part.tag == _q("w:lastRenderedPageBreak") or part.tag == _q("w:br") and part.get(_q("w:type")) == "page":
                    yield "page", {}
                elif part.tag in (_q("w:br"), _q("w:cr")):
                    yield "text", {"text": "\n", **form}
                elif part.tag in (_q("w:drawing"), _q("w:pict")):
                    yield "pictures", {"node": child if part.tag == _q("w:pict") else _wrap(part)}
        elif tag in (_q("m:oMath"), _q("m:oMathPara")):
            yield "text", {"text": "".join(t.text or "" for t in child.iter(_q("m:t"))), **dict.fromkeys(_FORMAT, False)}
        elif tag not in (_q("w:pPr"), _q("w:del"), _q("w:moveFrom")):
            yield from _pieces(child)


def _wrap(node):
    outer = ElementTree.Element("outer")
    outer.append(node)
    return outer


def _spans(pieces: list[dict]) -> list[dict]:
    """Pieces of the same format that follow each other, as one."""
    out: list[dict] = []
    for p in pieces:
        if not p["text"]:
            continue
        if out and all(out[-1][k] == p[k] for k in _FORMAT):
            out[-1] = {**p, "text": out[-1]["text"] + p["text"]}
        else:
            out.append(p)
    return out


def grid_markdown(grid: list[list[str]]) -> str:
    """A table of rows of cells: blank rows but the first left out, short rows filled, pipes escaped."""
    wide = max(map(len, grid), default=0)
    if not wide:
        return ""
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] + [""] * (wide - len(r)) for r in grid]
    rows = [r for k, r in enumerate(rows) if not k or any(r)]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * wide, *map(line, rows[1:])])


def _text(node) -> str:
    return "\n".join("".join(p["text"] for kind, p in _pieces(n) if kind == "text") for n in node.iter(_q("w:p")))


def table_grid(table) -> list[list[str]]:
    """Rows of cells; what spans several rows or columns is in each of them."""
    grid: list[list[str]] = []
    for tr in table.findall(_q("w:tr")):
        row: list[str] = []
        for tc in tr.findall(_q("w:tc")):
            p = tc.find(_q("w:tcPr"))
            span, merge = (None if p is None else p.find(_q(n)) for n in ("w:gridSpan", "w:vMerge"))
            goes_on = merge is not None and merge.get(_q("w:val"), "continue") == "continue"
            text = grid[-1][len(row)] if goes_on and grid and len(row) < len(grid[-1]) else _text(tc)
            row += [text] * (int(span.get(_q("w:val"), "1")) if span is not None else 1)
        grid.append(row)
    return grid


def walk(content: bytes) -> tuple[int, list[dict]]:
    """(pages, elements) of a document; an image has its picture's ``target`` and ``rotation`` in ``picture``."""
    package, page, out, count = Package(content), 1, [], 0

    def add(kind: str, text: str, **more) -> None:
        out.append({"page_number": page, "seq": float(len(out)), "type": kind, "content": text, "source": "native", **more})

    def images(node) -> None:
        nonlocal count
        for p in package.pictures(node):
            count += 1
            suffix = posixpath.splitext(p["target"])[1].lower() or ".bin"
            add("image", "", width=p["width"], height=p["height"], saved_path=f"images/picture_{count:03d}{suffix}", picture=p)

    def paragraph(node) -> None:
        nonlocal page
        held: list[dict] = []
        before = any(_on(p, "w:pageBreakBefore") for p, _ in package.chain(node))
        page += before and bool(out)
        pictures = []
        for kind, piece in _pieces(node):
            if kind == "text":
                held.append(piece)
            elif kind == "pictures":
                pictures.append(piece["node"])
            elif any(p["text"].strip() for p in held):
                # The rest of the paragraph is on the next page, but it is one.
                pictures.append(None)
            else:
                page += 1
        spans = _spans(held)
        text = "".join(s["text"] for s in spans)
        level = package.level(node)
        if text.strip() and not (level and _NUMERIC.fullmatch(text)):
            more = {"font": {"name": "", "size": 0.0, "bold": bool(level) or spans[0]["bold"], "italic": spans[0]["italic"]}}
            if level:
                more["heading_level"] = level
            elif package.in_list(node):
                more["extra"] = {"list_item": "true"}
            if len(spans) > 1:
                more["spans"] = spans
            elif spans[0]["underline"]:
                more["underline"] = True
            add("text", text, **more)
        for p in pictures:
            if p is None:
                page += 1
            else:
                images(p)

    def blocks(parent) -> None:
        for node in parent:
            if node.tag == _q("w:p"):
                paragraph(node)
            elif node.tag == _q("w:tbl"):
                grid = table_grid(node)
                if any(c.strip() for r in grid for c in r):
                    add("table", grid_markdown(grid), rows=len(grid))
                images(node)
            elif node.tag in (_q("w:sdt"), _q("w:sdtContent"), _q("w:ins")):
                blocks(node)

    blocks(package.body)
    return page, out


def read_docx(content: bytes, path: str = "") -> tuple[list[dict], list[dict]]:
    """A reader for :func:`foliospark.sources.files.binary_docset`: every page up to the last, with or without elements."""
    pages, found = walk(content)
    return [{"page_number": k, "page_type": "native"} for k in range(1, pages + 1)], [{k: v for k, v in e.items() if k != "picture"} for e in found]


def read_pictures(content: bytes) -> list[dict]:
    """The pictures of a document in the order of its text: place, path as in its elements, type, rotation and bytes. What the archive lacks has none."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names, out = set(archive.namelist()), []
    for e in walk(content)[1]:
        if e["type"] == "image":
            target = e["picture"]["target"]
            kind = TYPES.get(posixpath.splitext(target)[1].lower().lstrip("."), "application/octet-stream")
            out.append({"page_number": e["page_number"], "seq": e["seq"], "saved_path": e["saved_path"], "content_type": kind, "vector": kind in VECTORS, "rotation": e["picture"]["rotation"], "image": archive.read(target) if target in names else None})
    return out


def docx_pictures(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, page_number, seq, saved_path, content_type, vector, rotation, image) of the pictures in the DOCX files at path, doc_id as in binary_docset()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path).select(F.xxhash64("path").alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([{"doc_id": r.doc_id, **p} for p in read_pictures(bytes(r.content))], columns=["doc_id", "page_number", "seq", "saved_path", "content_type", "vector", "rotation", "image"])

    return files.mapInPandas(run, "doc_id long, page_number int, seq double, saved_path string, content_type string, vector boolean, rotation double, image binary")


def doc_reader(convert: Callable[[bytes], bytes]) -> Callable[[bytes, str], tuple[list[dict], list[dict]]]:
    """A reader of old Word files: convert makes a DOCX of one."""
    return lambda content, path: read_docx(convert(content), path)


def soffice(content: bytes, command: str = "soffice", timeout: float = 120.0) -> bytes:
    """A DOCX made by an office suite, in a folder of its own that is removed after; an error if it fails or makes none."""
    import pathlib
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        source = pathlib.Path(folder, "in.doc")
        source.write_bytes(content)
        done = subprocess.run([command, "--headless", "--convert-to", "docx", "--outdir", folder, str(source)], capture_output=True, text=True, timeout=timeout)
        made = source.with_suffix(".docx")
        if done.returncode or not made.exists():
            raise RuntimeError(f"no DOCX was made: {done.stderr.strip() or done.stdout.strip() or done.returncode}")
        return made.read_bytes()
