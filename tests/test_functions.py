"""Text, heading, table, formula and geometry functions on the cases their rules are about."""

import pytest
from pyspark.sql import functions as F

from foliospark.evaluate import metrics
from foliospark.functions import headings as H
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.functions.html_table import html_table_to_markdown
from foliospark.operators.formula import normalize_formulas
from foliospark.operators.line_unwrap import decide, join, unwrap
from foliospark.operators.ocr import char_overlap, normal_box
from foliospark.sources.files import merge_config, parse_json
from foliospark.sources.text import html_blocks


@pytest.fixture(scope="module")
def on(spark):
    def run(values, *functions):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
        rows = df.select("k", *(f(F.col("c")).alias(f"f{j}") for j, f in enumerate(functions))).orderBy("k").collect()
        return [r[1] if len(functions) == 1 else tuple(r)[1:] for r in rows]

    return run


def test_clean(on):
    got = on(["a\x00b\x7f", "\x93hi\x94", "ＡＢ１２＋，。", "你 好 ， 世 界 a b", "你　好", "x^{^{\\prime}} y^{\\prime}", "  a \t b\n c  ", "", None], X.clean)
    assert got == ["ab", "“hi”", "AB12+，。", "你好，世界 a b", "你好", "x' y'", "a b\n c", "", None]
    assert on(got[:-1], X.clean) == got[:-1]


def test_lines(on):
    assert on(["a\nb\r\nc\n", "", "\n", "x y"], X.lines) == [["a", "b", "c"], [], [""], ["x", "y"]]
    assert on(["# T  x\n<!-- PAGE 3 -->\n y"], X.for_comparison) == ["T x y"]
    assert on(["abc def", "x" * 90], lambda c: X.truncate(c, 80)) == ["abc def", "x" * 79 + "…"]


def test_numbering(on):
    cases = {"第一章 总则": ("chapter_cn", 1), "第三条 责任": ("article_cn", 3), "附件一": ("appendix_cn", 2), "一、概述": ("section_cn", 2), "（二）范围": ("section_cn_paren", 2), "1.2 Title": ("section_arabic_nested", 3), "1.2.3.4 T": ("section_arabic_nested", 5), "1.4费用": ("section_arabic_nested", 3), "(1) a": ("section_arabic_paren", 3), "1、评审": ("section_arabic_ideograph", 2), "3 Results": ("section_arabic_spaced", 2), "9．监督": ("section_arabic_root", 2), "## 1. Intro": ("section_arabic_root", 2), "2026 plan": (None, None), "text": (None, None)}
    assert on(list(cases), H.numbering_signal, H.numbering_level) == list(cases.values())


def test_predicates(on):
    assert on(["2026年3月", "a ..... 3", "12", "$200.00", "next ›", "Figure 2: x", "表 3.2", "x", "Real heading"], H.is_not_heading) == [True] * 8 + [False]
    assert on(["12", "- 3 -", "第 3 页", "iv", "MIX", "12a", "page"], H.is_page_number) == [True, True, True, True, True, False, False]
    assert on(["5\n算例分析", "5\nA sentence ends here.", "Title\nbody"], H.heading_text) == ["5 算例分析", "5", "Title"]
    assert on(["Figure 1: a plot", "Fig. 3 shows", "图 2 结果", "Table: costs", "表 1-2 数据", "Speech of figures", "x" * 200], H.caption_kind) == ["figure", "figure", "figure", "table", "table", None, None]
    assert on(["Courier New", "NimbusMonL", "Hack", "Hackney", "Arial", None], H.is_monospace) == [True, True, True, False, False, False]
    assert on(["Page 1: NUMBER MISMATCH", "jump from H1 to H3", "other thing"], H.warning_code) == ["number_mismatch", "heading_level_jump", "other"]


def test_tables(on):
    md = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"
    t = on([md, "one line", None], T.parse_table)
    assert (t[0].header, t[0].separator, t[0].rows) == (["a", "b"], ["---", "---"], [["1", "2"], ["3"]]) and t[1] is None and t[2] is None
    assert on([md], lambda c: T.build_table(T.parse_table(c).header, T.parse_table(c).separator, T.parse_table(c).rows)) == ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |"]
    assert on(["| OK | Back |\n|---|---|\n| OK | Back |\n|  |  |", md, "| | |\n|---|---|\n| | |"], T.is_degenerate) == [True, False, True]
    assert on([md, "text"], T.column_count) == [2, 1]


def test_html_tables():
    assert html_table_to_markdown("<table><tr><th colspan=2>A</th></tr><tr><th>x</th><th>y</th></tr><tr><td rowspan=2>1</td><td>2|3</td></tr><tr><td>4<br>5</td></tr></table>") == "| A > x | y |\n| --- | --- |\n| 1 | 2\\|3 |\n|  | 4 / 5 |"
    assert html_table_to_markdown("<table><tr><td>h</td></tr><tr><td>v</td></tr></table>") == "| h |\n| --- |\n| v |"
    assert html_table_to_markdown("no table") == "no table"


def test_formulas():
    cases = {"30℃": r"$30^{\circ}\mathrm{C}$", "H₂SiCl₂": r"$\mathrm{H_{2}SiCl_{2}}$", "200μL": r"$200\,\mathrm{\mu L}$", "a ≥ b": r"a $\ge$ b", "$a ≥ b$": "$a ≥ b$", "$ {}^{13} $C": "$^{13}C$", "CDCl$ _3 $": "$CDCl_{3}$", "$ x_{1} $": "$x_{1}$", "plain $5 and $6": "plain $5 and $6"}
    for text, want in cases.items():
        assert normalize_formulas(text) == want


def test_unwrap():
    assert decide("the quick", "brown fox", 40) == "merge" and decide("Done.", "Next", 40) == "keep" and decide("see Fig.", "Next", 40) == "uncertain"
    assert decide("a line", "- item", 40) == "keep" and decide("[0005]", "本发明", 40) == "merge" and decide("这是一个很长的句子没有结束标点符号啊", "继续写下去吧", 20) == "merge"
    assert join("exam-", "ple") == "example" and join("研究", "方法") == "研究方法" and join("研究", "The") == "研究 The" and join("a", "b") == "a b"
    assert unwrap("one\ntwo\n\n\nThree.\nfour", 40) == "one two\n\nThree.\nfour"
    text = unwrap("one\ntwo\n\n\nThree.\nfour", 40)
    assert unwrap(text, 40) == text


def test_metrics(on, spark):
    pairs = spark.createDataFrame([("a", "kitten", "sitting"), ("b", "", ""), ("c", "", "x"), ("d", "x" * 6000, "x" * 5999 + "y")], "document_name string, output string, expected string")
    got = {r.document_name: r for r in metrics.text_metrics(pairs).collect()}
    assert abs(got["a"].edit_distance - 3 / 7) < 1e-9 and got["b"].edit_distance == 0 and got["b"].char_f1 == 1 and got["c"].edit_distance == 1
    assert abs(got["d"].edit_distance - 1 / 6000) < 1e-9
    assert metrics.match_headings([(1, "ab"), (2, "c")], [(1, "abc"), (1, "c")]) == 1
    h = metrics.heading_metrics(spark.createDataFrame([("a", "# A\n## B C", "# A\n## BC\n### D"), ("b", "# A", "none")], "document_name string, output string, expected string")).orderBy("document_name").collect()
    assert (h[0].heading_precision, h[0].correct, h[1].heading_f1, h[1].applicable) == (1.0, 2, 0.0, False)
    r = metrics.residuals("# A\nextra | a | b | c |\n", "# A\nmissing line here\n")
    assert r["extra_blocks"] == r["missing_blocks"] == 1 and "table_markup_shape" in r["themes"]
    assert [round(x, 3) for x in on(["aab", "", "xyz"], lambda c: char_overlap(c, F.lit("abc")))] == [0.667, 0.0, 0.0]


def test_sources(tmp_path, monkeypatch):
    blocks = html_blocks("<title>t</title><nav><li>A</nav><h2>Hi</h2><p>one<p>two <b>b</b><img src=a.png alt=x><table><tr><td>1</table><footer>f</footer>")
    assert [(k, c, lv) for k, c, lv, _ in blocks] == [("header", "A", None), ("text", "Hi", 2), ("text", "one", None), ("text", "two b", None), ("image", "x", None), ("table", "| 1 |\n| --- |", None), ("footer", "f", None)]
    assert parse_json('```json\n{"a": 1}\n```') == {"a": 1} and parse_json('so: [1, {"b": 2}] ok') == [1, {"b": 2}] and parse_json("{broken") is None
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\nk: ${FOLIO_K:dflt}\n")
    (tmp_path / "x.yaml").write_text("extends: base.yaml\na: {c: 3}\n")
    assert merge_config(str(tmp_path / "x.yaml"), {"a.d": 4}) == {"a": {"b": 1, "c": 3, "d": 4}, "k": "dflt"}
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    with pytest.raises(ValueError):
        merge_config(str(tmp_path / "loop.yaml"))
    assert normal_box([1, 2, 3, 4]) == [1, 2, 3, 4] and normal_box([[0, 0], [2, 0], [2, 3], [0, 3]]) == [0, 0, 2, 3] and normal_box("junk") == [0.0] * 4
