"""Corrections by models that tests stand in for, and several tools on the same files."""

import json

import pytest
from test_pdf import PAGE, build

from foliospark.evaluate import tools
from foliospark.model import DOC, ELEMENT, PAGE as PAGES, DocSet, complete
from foliospark.operators import formula_fix as fix
from foliospark.operators import page, table
from foliospark.plans.pipeline import Config


def docset(spark, rows):
    """rows: (page, seq, type, content, source, merged_from)."""
    box = "named_struct('x0', 0D, 'y0', 0D, 'x1', 500D, 'y1', 20D)"
    e = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, page_number int, seq double, type string, content string, source string, merged_from array<int>").selectExpr("*", f"{box} as bbox", "0.99D as confidence")
    return DocSet(complete(spark.createDataFrame([(1,)], "doc_id long"), DOC), complete(e.select("doc_id", "page_number").distinct().selectExpr("*", "'native' as page_type"), PAGES), complete(e, ELEMENT))


def test_candidates_and_places():
    assert fix.candidates("then SO42- and H₂O in $x_{1}$ but plain words") == ["SO42-", "$x_{1}$", "H₂O"] or set(fix.candidates("then SO42- and H₂O in $x_{1}$ but plain words")) == {"SO42-", "$x_{1}$", "H₂O"}
    assert fix.candidates("no notation, and/or well-known") == [] and fix.signal("no notation") == 0
    box = {"x0": 0.0, "y0": 0.0, "x1": 1000.0, "y1": 40.0}
    assert fix.place_of(box, "ab\ncdXYcd", "XY") == {"x0": pytest.approx(1000 / 3 - 0.35 * 1000 / 3), "y0": 13.0, "x1": pytest.approx(2000 / 3 + 0.35 * 1000 / 3), "y1": 40.0}
    assert fix.place_of(box, "ab", "zz") == box


@pytest.mark.parametrize(("old", "new", "fits"), [("SO42-", "SO₄²⁻", True), ("$x _ 1$", "$ x _ 1$", True), ("$C_{23}H_{20}$", "C23H20", False), ("$C_{23}H_{20}$", "$C_{28}H_{20}$", True), ("H2O", "I cannot tell", False), ("H2O", "", False), ("abcd12", "a completely different sentence", False), ("abcdefgh12", "a", False)])
def test_guards(old, new, fits):
    assert fix.acceptable(old, new) is fits


def test_answers():
    say = lambda **k: json.dumps({"confidence": "high", "change_kind": "ocr_fix", "replacement_text": "SO₄²⁻", **k})
    assert fix.corrected("with SO42- in", "SO42-", say()) == "with $\\mathrm{SO_{4}^{2-}}$ in"
    assert all(fix.corrected("with SO42- in", "SO42-", a) is None for a in (say(confidence="low"), say(change_kind="format_only"), say(change_kind="none"), say(replacement_text="SO42-"), "no json", None))
    assert fix.corrected("without", "SO42-", say()) is None


def test_formulas_are_corrected_and_questions_counted(spark):
    d = docset(spark, [(1, 0.0, "text", "a b₁ c₂", "ocr", None), (1, 1.0, "text", "with SO₄2- in", "ocr", None), (1, 2.0, "text", "with SO₄2- in", "native", None), (1, 3.0, "text", "x₁ y₂ z₃", "ocr", None), (2, 0.0, "text", "late w₉", "ocr", None)])
    images = spark.createDataFrame([(1, 1, bytearray(b"one")), (1, 2, bytearray(b"two"))], "doc_id long, page_number int, image binary")

    def ask(image, prompt):
        if "\nz₃\n" in prompt or "\nw₉\n" in prompt:
            return '{"confidence": "high", "change_kind": "ocr_fix", "replacement_text": "q₅q₅"}'
        if "\nSO₄2-\n" not in prompt:
            raise OSError("no answer")
        return '{"confidence": "high", "change_kind": "ocr_fix", "replacement_text": "SO₄²⁻"}'

    got = [r.content for r in fix.correct_formulas(d, images, ask, most=4).elements.orderBy("page_number", "seq").collect()]
    assert got == ["a b₁ c₂", "with $\\mathrm{SO_{4}^{2-}}$ in", "with SO₄2- in", "x₁ y₂ z₃", "late w₉"]


def test_merged_tables_are_refined(spark):
    d = docset(spark, [(1, 0.0, "table", "| a |\n|---|\n| l |", "ocr", [1, 2]), (1, 1.0, "table", "| b |\n|---|", "ocr", None), (3, 0.0, "table", "| c |\n|---|", "ocr", [3, 4])])
    images = spark.createDataFrame([(1, k, bytearray(str(k).encode())) for k in (1, 2, 3)], "doc_id long, page_number int, image binary")
    for answer, want in (("| a |\n|---|\n| 1 |", "| a |\n|---|\n| 1 |"), ("sorry", "| a |\n|---|\n| l |")):
        got = table.refine_merged(d, images, lambda pages, prompt, answer=answer: answer if pages == [b"1", b"2"] and "| l |" in prompt else 1 / 0).elements.orderBy("page_number", "seq").collect()
        assert [r.content for r in got] == [want, "| b |\n|---|", "| c |\n|---|"]


def test_fragments_are_confirmed(spark):
    rows = [(p, float(k), "text", "x\n=\n1" if p < 3 else "a long enough line of text", "native", None) for p in (1, 2, 3) for k in range(10)]
    flagged = page.page_quality(docset(spark, rows))
    got = page.confirm_fragments(flagged, lambda system, sample: '{"has_formula_fragments": true}' if "json" not in sample else "")
    assert sorted(r.page_number for r in got.collect()) == [1, 2]
    assert page.confirm_fragments(flagged, lambda system, sample: "perhaps").count() == 0


def test_tools(spark, tmp_path):
    for name, data in (("a", build(PAGE)), ("b", b"broken")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "input.pdf").write_bytes(data)
    (tmp_path / "in" / "a" / "expected.md").write_text("Big Title")
    (tmp_path / "in" / "b" / "expected.md").write_text("x")
    ours = {"plain": tools.plain, "echo": tools.command(["echo", "Big Title"]), "fails": tools.command(["false"])}
    scores, outputs = tools.evaluate_tools(spark, str(tmp_path / "in"), ours)
    by = {(r.tool, r.document_name): r for r in scores.collect()}
    assert {k: r.status for k, r in by.items()} == {("plain", "a"): "ok", ("plain", "b"): "error", ("echo", "a"): "ok", ("echo", "b"): "ok", ("fails", "a"): "error", ("fails", "b"): "error"}
    assert by["echo", "a"].edit_distance == 0.0 and by["echo", "a"].char_f1 == 1.0 and by["plain", "a"].char_f1 < 1
    tools.write_evaluation(scores, outputs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/outputs")).filter("tool = 'plain' and output like 'Big Title%'").count() == 1 and spark.read.json(str(tmp_path / "out/manifest")).count() == 6
    rows = tools.settings(Config(judge_value=print, disabled=frozenset({"table"})), None, ["retain=3"])
    report = tools.tools_report(scores, rows)
    assert ("judge value", "on") in rows and ("read", "off") in rows and ("disabled", "table") in rows and "- overrides: `retain=3`" in report and "| echo | 2 | 2 |" in report
    assert len(tools.own()(tools.input_files(spark, str(tmp_path / "in")).filter("document_name = 'a'")).filter("output like '%Big Title%'").collect()) == 1


def test_ground_truth_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("one", "# é", '{"k": 1}'), ("two", "x", None)], "document_name string, expected string, meta string")
    assert sorted(r.path for r in tools.write_ground_truth(rows, str(tmp_path)).collect()) == ["one/expected.md", "one/meta.json", "two/expected.md"]
    assert (tmp_path / "one/expected.md").read_text() == "# é"
    with pytest.raises(Exception, match="not a name"):
        tools.write_ground_truth(rows.selectExpr("'../x' as document_name", "expected", "meta"), str(tmp_path))
