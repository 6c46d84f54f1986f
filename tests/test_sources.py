"""Word documents made here, read, and their pictures."""

import io
import zipfile

import pytest

from foliospark.model import DOC, ELEMENT, PAGE, DocSet, complete
from foliospark.operators import image
from foliospark.sources import docx
from foliospark.sources.files import binary_docset

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
STYLES = f'<w:styles {NS}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Own"><w:name w:val="Own"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="L"><w:name w:val="L"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="p1" Target="media/a.png"/><Relationship Id="p2" Target="media/b.emf"/><Relationship Id="x" Target="http://host/" TargetMode="External"/></Relationships>'


def para(text, style=None, **marks):
    run = "".join(f"<w:{k}/>" if v is True else f'<w:{k} w:val="{v}"/>' for k, v in marks.items())
    p = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{p}<w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def drawing(rel, rot=0):
    return f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="952500" cy="476250"/><a:graphic><a:xfrm rot="{rot}"/><a:blip r:embed="{rel}"/></a:graphic></wp:inline></w:drawing></w:r></w:p>'


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(text)}</w:tc>"


BODY = "".join(
    [
        para("The Title", "T"),
        para("Part", "Own"),
        para("1 2", "H2"),
        '<w:p><w:r><w:t xml:space="preserve">plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>er</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:hyperlink><w:r><w:rPr><w:u w:val="none"/></w:rPr><w:t xml:space="preserve"> link</w:t></w:r></w:hyperlink></w:p>',
        para("an item", "L"),
        para("under", None, u="single"),
        f'<w:tbl><w:tr>{cell("Head", "<w:gridSpan w:val=\"2\"/>")}</w:tr><w:tr>{cell("a|b", "<w:vMerge w:val=\"restart\"/>")}{cell("1")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("2")}</w:tr></w:tbl>',
        '<w:p><w:r><w:br w:type="page"/></w:r></w:p>',
        '<w:p><w:r><w:t>over</w:t><w:lastRenderedPageBreak/><w:t>flowing</w:t></w:r></w:p>',
        drawing("p1", 5400000),
        drawing("p2"),
        drawing("missing"),
        "<w:p><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath></w:p>",
        "<w:p/>",
    ]
)


def build(body=BODY, doctype=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"{doctype}<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/media/a.png", b"PNG")
        z.writestr("word/media/b.emf", b"EMF")
    return out.getvalue()


def test_docx_elements():
    pages, found = docx.read_docx(build())
    assert [p["page_number"] for p in pages] == [1, 2, 3]
    got = [(e["page_number"], e["type"], e["content"], e.get("heading_level")) for e in found]
    assert got == [(1, "text", "The Title", 1), (1, "text", "Part", 2), (1, "text", "plain bolder link", None), (1, "text", "an item", None), (1, "text", "under", None), (1, "table", "| Head | Head |\n|---|---|\n| a\\|b | 1 |\n| a\\|b | 2 |", None), (2, "text", "overflowing", None), (3, "image", "", None), (3, "image", "", None), (3, "image", "", None), (3, "text", "x=1", None)]
    assert [(s["text"], s["bold"]) for s in found[2]["spans"]] == [("plain ", False), ("bolder", True), (" link", False)]
    assert found[3]["extra"] == {"list_item": "true"} and found[4]["underline"] and found[7]["width"] == 100.0 and found[7]["saved_path"] == "images/picture_001.png"
    assert docx.read_docx(build("")) == ([{"page_number": 1, "page_type": "native"}], [])
    with pytest.raises(ValueError):
        docx.read_docx(build(doctype="<!DOCTYPE x>"))


def test_docx_pictures():
    got = docx.read_pictures(build())
    assert [(p["saved_path"], p["content_type"], p["vector"], p["rotation"], p["image"]) for p in got] == [("images/picture_001.png", "image/png", False, 90.0, b"PNG"), ("images/picture_002.emf", "image/x-emf", True, 0.0, b"EMF"), ("images/picture_003.bin", "application/octet-stream", False, 0.0, None)]


def test_tables_as_markdown():
    assert docx.grid_markdown([["a", "b"], ["", " "], ["1"], ["x\ny", "|"]]) == "| a | b |\n|---|---|\n| 1 |  |\n| x y | \\| |"
    assert docx.grid_markdown([]) == docx.grid_markdown([[]]) == ""


def test_binary_docset_reads_files_once(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(build())
    (tmp_path / "b.doc").write_bytes(b"old")
    (tmp_path / "c.docx").write_bytes(build(""))
    seen = tmp_path / "seen"
    seen.mkdir()
    made, once = build(para("from old")), str(seen / "once")

    def convert(content):
        with open(once, "a") as f:
            f.write("x")
        return made if content == b"old" else b""

    d = binary_docset(spark, f"{tmp_path}/*.doc*", {"docx": docx.read_docx, "doc": docx.doc_reader(convert)})
    assert sorted((r.source_format, r.page_count) for r in d.docs.collect()) == [("doc", 1), ("docx", 1), ("docx", 3)]
    assert d.elements.filter("content = 'from old'").count() == 1 and d.pages.count() == 5 and d.elements.count() == 12
    assert (seen / "once").read_text() == "x"
    with pytest.raises(Exception, match="no reader"):
        binary_docset(spark, f"{tmp_path}/*.doc*", {"docx": docx.read_docx})
    p = docx.docx_pictures(spark, str(tmp_path))
    assert sorted((r.saved_path, bytes(r.image or b"")) for r in p.collect()) == [("images/picture_001.png", b"PNG"), ("images/picture_002.emf", b"EMF"), ("images/picture_003.bin", b"")]

    def read(pictures):
        if any(x == b"EMF" for x in pictures):
            raise OSError("no pixels")
        return [[{"label": "text", "text": " says ", "bbox": None}, {"label": "table", "text": "| t |", "bbox": None}, {"label": "text", "text": "", "bbox": None}] for _ in pictures]

    e = image.attach_evidence(d, image.picture_evidence(p, read)).elements.filter("type = 'image'").orderBy("saved_path").collect()
    assert [(r.evidence_text, r.evidence_table) for r in e] == [("says", "| t |"), (None, None), (None, None)]


def test_native_images_are_preferred(spark):
    rows = [(1, 1, 0.0, "image", "v", 0.0, 0.0, 100.0, 100.0, None, True), (1, 1, 1.0, "image", "n", 10.0, 10.0, 90.0, 90.0, 7, False), (1, 1, 2.0, "image", "w", 80.0, 80.0, 200.0, 200.0, None, True), (1, 2, 0.0, "image", "x", 0.0, 0.0, 100.0, 100.0, None, True)]
    e = spark.createDataFrame(rows, "doc_id long, page_number int, seq double, type string, elem_id string, x0 double, y0 double, x1 double, y1 double, xref long, vector_figure boolean").selectExpr("*", "named_struct('x0', x0, 'y0', y0, 'x1', x1, 'y1', y1) as bbox")
    d = DocSet(complete(e.select("doc_id").distinct(), DOC), complete(e.select("doc_id", "page_number").distinct(), PAGE), complete(e, ELEMENT))
    assert [(r.elem_id, r.skip_reason) for r in image.prefer_native(d).elements.orderBy("page_number", "seq").collect()] == [("v", "native_image_preferred"), ("n", None), ("w", None), ("x", None)]
