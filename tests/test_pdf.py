"""PDF files made here, and read."""

import zlib

import pytest

from foliospark.plans.pipeline import parse_result, read_documents
from foliospark.sources import pdf

FONTS = b"5 0 obj <</Type/Font/Subtype/Type1/BaseFont/Helvetica>> endobj\n6 0 obj <</Type/Font/Subtype/TrueType/BaseFont/ABCDEF+Own-Bold/FirstChar 65/Widths[700 700]/Encoding<</Differences[65/eacute/uni4E2D 67/fi]>>>> endobj\n"
IMAGE = b"7 0 obj <</Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB/Length 6>>\nstream\nabcdef\nendstream endobj\n"


def build(content, more=b"", page=b"", trailer=b"", flate=True):
    c = content.encode("latin-1")
    c = zlib.compress(c) if flate else c
    head = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]>> endobj % a remark\n3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R/F2 6 0 R/F3 8 0 R>>/XObject<</I 7 0 R/X 9 0 R>>>>" + page + b">> endobj\n"
    body = b"4 0 obj <</Length %d%s>>\nstream\n" % (len(c), b"/Filter/FlateDecode" if flate else b"") + c + b"\nendstream endobj\n"
    return head + body + FONTS + IMAGE + more + b"trailer <</Root 1 0 R" + trailer + b">>\n%%EOF"


PAGE = "BT /F1 20 Tf 50 740 Td (Big Title) Tj ET BT /F1 10 Tf 50 700 Td 12 TL (First line of text) Tj T* (second \\(line\\) \\351) Tj ET BT /F1 10 Tf 1 0 0 1 300 700 Tm [(sp)-20(lit)-600(word)] TJ ET 300 698 m 326 698 l S q 100 0 0 50 400 500 cm /I Do Q 50 400 200 0.5 re f 50 380 m 250 380 l S 50 420 m 250 420 l S 50 380 m 50 420 l S 150 380 m 150 420 l S 250 380 m 250 420 l S BT /F1 8 Tf 55 405 Td (A) Tj 100 0 Td (B) Tj -100 -20 Td (1) Tj 100 0 Td (2) Tj ET"


def test_page():
    pages, found = pdf.read_pdf(build(PAGE))
    assert pages == [{"page_number": 1, "width": 600.0, "height": 800.0, "drawing_count": 7, "curve_count": 0}]
    got = [(e["type"], e["content"]) for e in found]
    assert got[:4] == [("text", "Big Title"), ("text", "First line of text\nsecond (line) é"), ("text", "split word"), ("image", "")] and ("table", "| A | B |\n|---|---|\n| 1 | 2 |") in got
    assert found[0]["font"] == {"name": "Helvetica", "size": 20.0, "bold": False, "italic": False} and found[0]["bbox"] == {"x0": 50.0, "y0": 44.0, "x1": 140.0, "y1": 64.0}
    assert found[3]["bbox"] == {"x0": 400.0, "y0": 250.0, "x1": 500.0, "y1": 300.0} and found[3]["saved_path"] == "images/p1_x7.png"
    assert [(s["text"], s["underline"]) for s in found[2]["spans"]] == [("split ", True), ("word", False)]
    assert pdf.pdf_images(build(PAGE))[0]["image"].startswith(b"\x89PNG")
    assert [(e["type"], e["content"]) for e in pdf.read_pdf(build(PAGE, flate=False))[1]] == got


def test_fonts():
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<4E2D6587> <0021>] endbfrange"
    more = b"8 0 obj <</Type/Font/Subtype/Type0/BaseFont/W/DescendantFonts[10 0 R]/ToUnicode 11 0 R>> endobj 10 0 obj <</DW 500/W[1 [1000 250] 3 4 750]>> endobj 11 0 obj <</Length %d>> stream\n%s\nendstream endobj\n" % (len(cmap), cmap.encode())
    found = pdf.read_pdf(build("BT /F3 10 Tf 50 700 Td <000100020003000400050006> Tj ET BT /F2 10 Tf 50 500 Td (ABC) Tj ET", more))[1]
    assert [(e["content"], e["font"]["name"], e["font"]["bold"]) for e in found] == [("Aabc中文!", "W", False), ("é中fi", "Own-Bold", True)]
    assert found[0]["bbox"]["x1"] == pytest.approx(50 + 10 + 2.5 + 7.5 + 7.5 + 5 + 5)


@pytest.mark.parametrize(("turn", "size", "corner"), [(0, (600, 800), (50, 92)), (90, (800, 600), (698, 50)), (180, (600, 800), (450, 698)), (270, (800, 600), (92, 450))])
def test_rotated_pages(turn, size, corner):
    pages, found = pdf.read_pdf(build("q 100 0 0 10 50 698 cm /I Do Q", page=b"/Rotate %d" % turn))
    assert (pages[0]["width"], pages[0]["height"]) == size
    assert (found[0]["bbox"]["x0"], found[0]["bbox"]["y0"]) == pytest.approx(corner)


def test_forms_inline_images_and_object_streams():
    inner = b"BT /F1 10 Tf 0 0 Td (within) Tj ET"
    packed = b"12 0 13 2 [] <</Own (value)>>"
    more = b"9 0 obj <</Subtype/Form/Matrix[1 0 0 1 10 20]/Length %d>>\nstream\n%s\nendstream endobj 20 0 obj <</Type/ObjStm/N 2/First 10/Length %d>>\nstream\n%s\nendstream endobj\n" % (len(inner), inner, len(packed), packed)
    data = build("q 2 0 0 2 100 100 cm /X Do Q q 30 0 0 30 0 0 cm BI /W 1 /H 1 ID \x01EI\x02 EI Q BT /F1 10 Tf 300 300 Td (after) Tj ET", more)
    found = pdf.read_pdf(data)[1]
    assert [(e["type"], e["content"]) for e in found] == [("text", "after"), ("text", "within"), ("image", "")]
    assert found[1]["bbox"]["x0"] == 120.0 and found[1]["font"]["size"] == 20.0
    assert pdf.File(data).objects[13] == {"Own": b"value"}
    # A form that draws itself comes to an end.
    again = b"/X Do"
    pdf.read_pdf(build("/X Do", b"9 0 obj <</Subtype/Form/Resources<</XObject<</X 9 0 R>>>>/Length %d>>\nstream\n%s\nendstream endobj\n" % (len(again), again)))


def test_predictors_are_undone():
    rows = [bytes([k, k + 1, k + 2, 7 * k % 256]) for k in range(6)]
    out, above = b"", bytes(4)
    for kind, row in zip((0, 1, 2, 3, 4, 4), rows, strict=True):
        paeth = lambda a, b, c: min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        left = lambda k, r: r[k - 1] if k else 0
        guess = [(0, left(k, row), above[k], (left(k, row) + above[k]) // 2, paeth(left(k, row), above[k], left(k, above)))[kind] for k in range(4)]
        out += bytes([kind]) + bytes((row[k] - guess[k]) & 255 for k in range(4))
        above = row
    assert pdf._predicted(out, {"Predictor": 15, "Columns": 4}) == b"".join(rows)


def test_files_that_cant_be_read():
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read_pdf(build("", trailer=b"/Encrypt 30 0 R", more=b"30 0 obj <<>> endobj\n"))
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.read_pdf(b"text")
    assert pdf.read_pdf(b"%PDF-1.7\n") == ([], []) and pdf.read_pdf(build("BT (unended"))[1] == []


def test_files_to_markdown(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(PAGE))
    d = read_documents(spark, str(tmp_path))
    assert d.elements.filter("content in ('A', '1')").count() == 0 and [r.page_type for r in d.pages.collect()] == ["native"]
    r = parse_result(d)
    assert "| A | B |\n|---|---|\n| 1 | 2 |" in r.markdown.first().markdown and "First line of text" in r.markdown.first().markdown
