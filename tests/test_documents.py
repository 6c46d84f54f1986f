"""Operators on small pages made by hand."""

import pytest
from pyspark.sql import functions as F

from foliospark.model import DOC, ELEMENT, PAGE, DocSet, complete
from foliospark.operators import chapter, code_block, content_value, crossref, header_footer, ocr, page, reading_order, table, vlm_review
from foliospark.services.clients import Canned, HttpModel
from foliospark.sinks import chapters, markdown
from foliospark.verify import checks


@pytest.fixture(scope="module")
def make(spark):
    def build(rows, pages=None, width=612.0, height=792.0):
        """rows: (page, seq, type, content, (x0, y0, x1, y1) or None, more columns)."""
        import json

        flat = [json.dumps({"doc_id": 1, "page_number": p, "seq": float(s), "type": t, "content": c, "source": "native", "bbox": dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) if b else None, **more}) for p, s, t, c, b, more in rows]
        e = spark.createDataFrame([(x,) for x in flat], "j string").select(F.from_json("j", ELEMENT).alias("e")).select("e.*")
        n = pages or max((r[0] for r in rows), default=1)
        p = spark.createDataFrame([(1, k, width, height, "native") for k in range(1, n + 1)], "doc_id long, page_number int, width double, height double, page_type string")
        return DocSet(complete(spark.createDataFrame([(1,)], "doc_id long"), DOC), complete(p, PAGE), complete(e))

    return build


def rows_of(d, *columns):
    return [tuple(r[c] for c in columns) for r in d.elements.orderBy("page_number", "seq").collect()]


def test_headers_and_footers(make):
    rows = []
    for p in range(1, 6):
        rows += [(p, 0, "text", "Annual Report", (50, 10, 300, 25), {}), (p, 1, "text", f"Body of page {p}", (50, 100, 500, 700), {}), (p, 2, "text", f"- {p} -", (290, 770, 320, 785), {})]
    got = rows_of(header_footer.strip_headers_footers(make(rows)), "page_number", "content", "retained_identity")
    assert got == [(1, "Annual Report", True)] + [(p, f"Body of page {p}", None) for p in range(1, 6)]


def test_section_headers(make):
    rows = [(p, 0, "text", f"说明书 {p}/2 页", (50, 36, 300, 50), {}) for p in (1, 2)] + [(p, 1, "text", "正文", (50, 200, 300, 220), {}) for p in (1, 2)]
    assert rows_of(header_footer.promote_section_headers(make(rows)), "page_number", "content", "heading_level") == [(1, "说明书", 1), (1, "正文", None), (2, "正文", None)]


def test_two_columns(make):
    rows = [(1, 0, "text", "Title", (72, 50, 540, 70), {})] + [(1, k + 1, "text", f"{'L' if k % 2 == 0 else 'R'}{k // 2}", (72 if k % 2 == 0 else 330, 100 + 50 * (k // 2), 290 if k % 2 == 0 else 540, 130 + 50 * (k // 2)), {}) for k in range(8)]
    d = make(rows)
    layout = reading_order.detect_columns(d).collect()
    assert len(layout) == 1 and 280 < layout[0].gutter_x < 330 and layout[0].confidence >= 0.6
    assert [c for (c,) in rows_of(reading_order.reading_order(d), "content")] == ["Title", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"]


def test_code_blocks(make):
    mono, body = ({"font": {"name": n, "size": 10.0, "bold": False, "italic": False}} for n in ("Courier", "Serif"))
    rows = [(1, 0, "text", "Run this:", (1, 1, 50, 10), body), (1, 1, "text", "ls -l ", (1, 12, 60, 20), mono), (1, 2, "text", "cd /", (1, 22, 80, 30), mono), (1, 3, "text", "1. inline", (1, 32, 80, 40), mono)]
    got = rows_of(code_block.code_blocks(make(rows)), "content", "code_block", "bbox")
    assert [(c, k) for c, k, _ in got] == [("Run this:", None), ("ls -l\ncd /", True), ("1. inline", None)] and got[1][2].x1 == 80 and got[1][2].y1 == 30
    only = make([(1, k, "text", "x", None, mono) for k in range(2)])
    assert rows_of(code_block.code_blocks(only), "code_block") == [(None,), (None,)]


def test_headings(make):
    f = lambda size, bold=False: {"font": {"name": "S", "size": size, "bold": bold, "italic": False}}
    body = "This is body text that goes on for a while and ends with a stop. " * 3
    rows = [(1, 0, "text", "第一章 总则", (50, 50, 300, 70), f(18.0)), (1, 1, "text", body, (50, 100, 500, 200), f(10.0)), (1, 2, "text", "1.2 Scope", (50, 230, 300, 245), f(14.0)), (1, 3, "text", "2026年3月", (50, 300, 300, 315), f(18.0)), (1, 4, "text", body, (50, 330, 500, 400), f(10.0)), (1, 5, "text", "一、概述", (50, 430, 300, 445), f(10.0))]
    assert rows_of(chapter.detect_headings(make(rows)), "heading_level") == [(1,), (None,), (3,), (None,), (None,), (2,)]


def test_heading_rules():
    assert chapter.split_heading("3.1\nScope of\nwork\nBody text here.", 2) == (["3.1 Scope of work"], "Body text here.") or chapter.split_heading("3.1\nScope of\nwork\nBody.", 2)[0][0].startswith("3.1 Scope")
    assert chapter.split_heading("Title\nA subtitle\nThis is body text.", 1) == (["Title", "A subtitle"], "This is body text.")
    assert chapter.split_heading("Heading\nbody text.", 2) == (["Heading"], "body text.")
    toc = [{"type": "text", "content": c, "heading_level": None} for c in ("目 录", "第一章 公告 .... 2", "第二章 说明 …… 5", "This is a long body text that isn't an entry at all and goes on and on beyond eighty.")]
    got = chapter.mark_toc(toc)
    assert got[0]["heading_level"] == 1 and [bool(r.get("toc_entry")) for r in got] == [False, True, True, False]


def test_cross_page_tables(make):
    t = "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |"
    rows = [(1, 0, "table", t, (50, 400, 500, 780), {}), (2, 0, "text", "- 2 -", (290, 770, 320, 785), {}), (3, 0, "table", "| a | b | c |\n|---|---|---|\n| 4 | 5 | 6 |", (50, 20, 500, 300), {}), (3, 1, "text", "after", (50, 400, 500, 420), {})]
    got = rows_of(table.merge_cross_page(make(rows)), "type", "content", "merged_from", "rows")
    assert got[0] == ("table", t + "\n| 4 | 5 | 6 |", [1, 3], 3) and [g[0] for g in got] == ["table", "text", "text"]


def test_captions(make):
    rows = [(1, 0, "image", "", (100, 100, 400, 300), {}), (1, 1, "text", "图 1 系统结构", (150, 310, 350, 325), {}), (1, 2, "text", "Table 1: costs", (100, 400, 300, 415), {}), (1, 3, "table", "| a | b |\n|---|---|\n| 1 | 2 |", (100, 420, 400, 600), {})]
    assert rows_of(crossref.captions(make(rows)), "caption", "skip_render") == [("图 1 系统结构", None), (None, True), (None, True), ("Table 1: costs", None)]


def test_value(make):
    body = "A paragraph of body text that is long enough to count as such."
    rows = [(1, k, "text", body, (100, 200 + 40 * k, 500, 230 + 40 * k), {}) for k in range(4)] + [(1, 9, "text", "OK", (560, 770, 600, 790), {})]
    assert rows_of(content_value.content_value(make(rows)), "skip_render") == [(None,)] * 4 + [(True,)]


def test_text_in_tables_and_pages(make):
    rows = [(1, 0, "table", "| a |", (0, 0, 100, 100), {}), (1, 1, "text", "in", (10, 10, 50, 50), {}), (1, 2, "text", "half out", (80, 80, 200, 200), {}), (1, 3, "text", "no box", None, {})]
    assert [c for (c,) in rows_of(page.drop_text_in_tables(make(rows)), "content")] == ["| a |", "half out", "no box"]
    scan = make([(1, 0, "image", "", (0, 0, 612, 792), {}), (1, 1, "text", "x", (1, 1, 5, 5), {})])
    assert [r.page_type for r in page.classify_pages(scan).pages.collect()] == ["scanned"]


def test_recognition(make, spark):
    d = make([(1, 0, "text", "native text here", (50, 50, 300, 70), {})])
    blocks = [{"label": "doc_title", "text": "A Title", "bbox": [0, 0, 200, 40]}, {"label": "text", "text": "native text here", "bbox": [0, 50, 200, 90]}, {"label": "footer", "text": "x", "bbox": None}, {"label": "image", "text": "", "bbox": [0, 100, 400, 400]}, {"label": "table", "text": "<table><tr><td>a</td></tr></table>", "bbox": [0, 500, 9, 509]}]
    images = spark.createDataFrame([(1, 1, b"p", 1224.0, 1584.0)], "doc_id long, page_number int, image binary, render_width double, render_height double")
    read = ocr.recognise(images, lambda pages: [[dict(b) for b in blocks]])
    e = ocr.block_elements(read, d.pages)
    assert [(r.type, r.heading_level, r.content) for r in e.orderBy("seq").collect()] == [("text", 1, "A Title"), ("text", None, "native text here"), ("image", None, ""), ("table", None, "| a |\n| --- |")]
    assert e.filter("type = 'image'").first().bbox.x1 == 200
    got = [(t, c) for t, c in rows_of(ocr.integrate(d, e), "type", "content")]
    assert ("text", "A Title") in got and got.count(("text", "native text here")) == 1


def test_corrections():
    rows = [{"doc_id": 1, "page_number": 1, "seq": float(k), "elem_id": str(k), "type": "text", "content": c, "source": "ocr", "spans": None, "heading_level": None, "__answer": '{"corrections": [{"type": "fix_text", "element_index": 0, "original": "teh", "corrected": "the"}, {"type": "fix_text", "element_index": 1, "original": "a,b", "corrected": "a，b"}, {"type": "add_missing", "content": "new", "insert_after_index": 0}, {"type": "other"}]}'} for k, c in enumerate(["teh end", "a,b"])]
    assert [(r["content"], r["source"]) for r in vlm_review.apply_corrections(rows)] == [("the end", "vlm"), ("new", "vlm"), ("a,b", "ocr")]


def test_render_chapters_and_checks(make):
    rows = [(1, 0, "text", "Intro", None, {}), (1, 1, "text", "One", None, {"heading_level": 1}), (1, 2, "text", "Deep", None, {"heading_level": 3}), (2, 0, "text", "ab", None, {"spans": [{"text": "a", "bold": True, "italic": False, "underline": False, "sup": False}, {"text": "b", "bold": False, "italic": False, "underline": True, "sup": False}]}), (2, 1, "image", "", None, {"saved_path": "images/x.png", "description": "A plot"}), (2, 2, "text", "gone", None, {"skip_render": True})]
    d = make(rows)
    md = markdown.render(d)
    assert md.first().markdown == "<!-- PAGE 1 -->\nIntro\n\n# One\n\n### Deep\n\n<!-- PAGE 2 -->\n**a**<u>b</u>\n\n![A plot](images/x.png)\n\n> A plot"
    ch = chapters.render_chapters(d.elements).orderBy("chapter").collect()
    assert [(c.title, c.file) for c in ch] == [("前言", "ch_01.md"), ("One", "ch_02.md")] and "](../images/x.png)" in ch[1].markdown
    assert chapters.toc_index(d.elements).first()["index"] == "# 目录\n\n- [前言](chapters/ch_01.md)\n- [One](chapters/ch_02.md)\n    - Deep\n"
    w = {r.warning for r in checks.headings(d.elements).collect()}
    assert w == {"Page 1: heading level jump from H1 to H3 (Deep).", "Page 1: orphan H3 heading without H2 parent (Deep)."}
    w |= {r.warning for r in checks.verify(d, md, chapters.render_chapters(d.elements), d.elements.selectExpr("doc_id", "'images/y.png' as path").limit(1)).collect()}
    assert w == {"Page 1: heading level jump from H1 to H3 (Deep).", "Page 1: orphan H3 heading without H2 parent (Deep).", "Image reference 'images/x.png' in Markdown but file not found on disk.", "Image file 'y.png' on disk but not referenced in Markdown.", "Rendered text volume drifted beyond tolerance: source=22 chars, output=42 chars."}


def test_clients():
    calls = []

    def post(url, body, headers, timeout):
        import urllib.error

        calls.append(url)
        if url.endswith("responses"):
            raise urllib.error.HTTPError(url, 404, "", None, None)
        return {"choices": [{"message": {"content": "```json\n{}\n```"}}]}

    m = HttpModel("http://model.example/v1/", "m", post=post, sleep=lambda s: None)
    assert m.complete("s", "u") == "{}" and m.complete("s", "u") == "{}" and [c.rpartition("/")[2] for c in calls] == ["responses", "completions", "completions"]
    assert Canned({Canned.key("s", "u"): "yes"}).complete("s", "u") == "yes"


def test_whole_run_over_documents(spark):
    """All stages, rendering, chapters and checks over a whole table."""
    from foliospark.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["parse_documents"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(texts) and all(r.pages == -(-len(texts[i].split("\n")) // 40) for i, r in rows.items())
    # Running heads of later pages and page numbers are gone, words of the text aren't.
    assert all(r.elements <= len(texts[i].split("\n")) + 2 * r.pages for i, r in rows.items())
    assert sum(r.chars or 0 for r in rows.values()) > 0.8 * sum(map(len, texts.values()))


def test_fold_keeps_what_rules_dont_see(spark):
    from foliospark.operators.fold import fold

    e = spark.range(3000).selectExpr("id % 7 as doc_id", "1 as page_number", "cast(id as double) as seq", "cast(id as string) as content", "map('k', cast(id as string)) as extra", "array(id) as `a.b`")

    def rule(rows):
        return [{**r, "content": r["content"] + "!"} for r in rows[::-1] for _ in range(2) if int(r["content"]) % 3]

    got = fold(e, ("doc_id",), rule, columns=("content",))
    rows = got.collect()
    assert got.columns == e.columns and len(rows) == 4000
    assert all(r.content == r.extra["k"] + "!" and r["a.b"] == [int(r.seq)] and int(r.seq) % 7 == r.doc_id for r in rows)


def test_split_tables_far_apart():
    t = "| a | b |\n|---|---|\n| 1 | 2 |"
    rows = [{"page_number": n, "seq": 0.0, "type": "table", "content": t, "bbox": {"x0": 0, "y0": y0, "x1": 9, "y1": y1}, "__height": 100.0} for n, y0, y1 in ((1, 50, 99), (10**9, 1, 20))]
    got = table.merge_split_tables(rows)
    assert len(got) == 1 and got[0]["merged_from"] == [1, 10**9] and got[0]["rows"] == 3


def test_fold_tells_null_lists_from_empty_ones(spark):
    """Lists and maps are sent to Python empty where they are null; what a rule only reads comes back as it was."""
    from foliospark.operators.fold import fold

    e = spark.range(4).selectExpr("1L as doc_id", "1 as page_number", "cast(id as double) as seq", "cast(id as string) as content", "if(id = 0, null, if(id = 1, array(), array(id))) as a", "if(id = 0, null, array(id)) as b", "if(id = 2, null, map('k', id)) as m", "cast(null as int) as v", "cast(null as string) as w")

    def rule(rows):
        assert [r["a"] for r in rows] == [None, [], [2], [3]] and all(r["w"] is None for r in rows)
        for r in rows:
            r["v"], r["content"] = 7, "not written"
        return rows[::-1]

    got = fold(e, ("doc_id",), rule, columns=("content", "a", "v", "w"), changes=("v",))
    rows = {r.seq: r for r in got.collect()}
    assert got.columns == e.columns and all(r.v == 7 and r.w is None and r.content == str(int(k)) for k, r in rows.items())
    assert [rows[k].a for k in range(4)] == [None, [], [2], [3]] and [rows[k].b for k in range(4)] == [None, [1], [2], [3]] and [rows[k].m for k in range(4)] == [{"k": 0}, {"k": 1}, None, {"k": 3}]


def test_split_tables_move_documents_once(spark):
    """One exchange by document, which both branches read, instead of five."""
    from foliospark.runtime import whole_documents

    e = complete(spark.range(10).selectExpr("id % 3 doc_id", "cast(id as int) page_number", "0d seq", "'table' type", "'| a |' content"), ELEMENT).repartition("doc_id")
    p = complete(e.selectExpr("doc_id", "page_number", "612d width", "792d height"), PAGE)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with whole_documents(spark):
            plan = table.merge_cross_page(DocSet(None, p, e)).elements._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    # Each of the two branches shows the exchanges of elements and of pages; nothing else is moved.
    assert plan.count("Exchange hashpartitioning") == 4


def test_value_works_out_a_text_once(monkeypatch):
    made = []
    monkeypatch.setattr(content_value, "_text", lambda e, text=content_value._text: made.append(e["seq"]) or text(e))
    box = lambda k: {"x0": 72.0, "y0": 30.0 * k, "x1": 300.0, "y1": 30.0 * k + 12}
    rows = [{"page_number": 2, "seq": float(k), "type": "text", "content": f"A line of some length, number {k}.", "bbox": box(k), "__pw": 612.0, "__ph": 792.0, "__left": 72.0, "__right": 300.0} for k in range(20)]
    got = content_value.score_page(rows)
    assert len(made) == 20 and all(r["value_score"] > 0.5 for r in got)


def test_contents_move_pages_once(spark, make):
    """One exchange by page, which each branch shows, instead of five; white space around a header doesn't hide it."""
    rows = [(1, 0, "text", " " * 40 + "Contents ", None, {}), (1, 1, "text", "One .... 1", None, {}), (1, 2, "text", "Two .... 2", None, {}), (2, 0, "text", "Plain", None, {})]
    e = chapter.toc_blocks(make(rows)).elements
    assert [(r.page_number, r.toc_header, r.toc_entry) for r in e.orderBy("page_number", "seq").collect()] == [(1, True, None), (1, None, True), (1, None, True), (2, None, None)]
    assert e._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
