"""Work that is to grow with the input alone."""

import time
from collections import Counter

from pyspark.sql import functions as F

from foliospark.evaluate.runs import tool_scores
from foliospark.functions import text as X
from foliospark.functions.arrow import ROWS
from foliospark.functions.text import WHITE, compact, for_comparison, py_strip, truncate
from foliospark.operators.chapter import fallback_candidates
from foliospark.operators.formula import CANDIDATES, correction_score, has_indicators
from foliospark.operators.line_unwrap import usual_length
from foliospark.operators.ocr import char_overlap
from foliospark.sources.text import text_docset


def seconds(df):
    best = 1e9
    for _ in range(3):
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - start)
    return best


def test_overlap_costs_the_same_for_many_different_characters(spark):
    text = lambda kinds: "".join(chr(0x4E00 + k % kinds) for k in range(4000))
    df = spark.range(0, 600, 1, 1)
    cost = {kinds: seconds(df.select(char_overlap(F.concat(F.lit(text(kinds)), F.col("id").cast("string")), F.lit(text(kinds))))) for kinds in (4, 2000)}
    assert cost[2000] < 12 * cost[4]


def test_overlap_over_slices(spark):
    texts = ["", "aab", "naïve 中中文", "😀😀a\0", "x" * 50]
    df = spark.createDataFrame([(k, texts[k % 5], texts[(k * 3 + 1) % 5]) for k in range(2 * ROWS + 1)], "k int, a string, b string")
    for r in df.withColumn("o", char_overlap(F.col("a"), F.col("b"))).collect():
        assert r.o == (sum((Counter(r.a) & Counter(r.b)).values()) / len(r.a) if r.a else 0.0)


def test_tools_texts_move_once(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "document_name int, text string")
    half = lambda x: x.filter("document_name <> 1").select("document_name", F.when(F.col("document_name") != 2, F.col("text")).alias("output"))
    want = docs.filter("document_name <> 3").select("document_name", F.when(F.col("document_name") != 4, F.col("text")).alias("expected"))
    score = lambda p, by: p.select(by, (F.col("output") == F.col("expected")).cast("int").alias("same"))
    s = tool_scores(docs, {"half": half}, score, want)
    assert {r.document_name: (r.status, r.same) for r in s.collect()} == {0: ("ok", 1), 1: ("error", None), 2: ("error", None), 3: ("artifact_only", None), 4: ("artifact_only", None), 5: ("ok", 1)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tool_scores(docs, {"half": half}, score, want)._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The side that gives the status knows of texts only whether they are there.
    assert "__made" in str(plan) and "__wanted" in str(plan)


def test_white_space_at_ends(spark):
    texts = [WHITE + "a " + WHITE + " b" + WHITE, WHITE, "", "a\x1c", "​x ", "# a\n\n## b  c\t<!-- PAGE 3 -->d", "a #b\r\n #　c", "##　x  y"]
    old = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    compared = lambda c: old(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?mU)^#{1,6}\s+", ""), r"<!-- PAGE \d+ -->", ""), r"(?U)\s+", " "))
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select(py_strip(F.col("c")).alias("a"), old(F.col("c")).alias("b"), for_comparison(F.col("c")).alias("x"), compared(F.col("c")).alias("y")).collect():
        assert r.a == r.b and r.x == r.y


def test_notation_is_looked_for_where_it_can_be(spark):
    long_class = "[" + "".join("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ℃°μ≥≤≫≪±×÷≠≈") + r"]|\$ (?:\{\}|_)"
    rows = ["plain", "50 °C", "é only", "a$ _b$", "a$ {}^x$", "x₂", r"\alpha", "m^{2}", "k_{1}", "a_b", "$x$", "$", "H2O", None]
    plain = lambda c: sum((F.when(c.rlike(x), 1).otherwise(0) for x in CANDIDATES.values()), F.when(c.rlike(long_class), 1).otherwise(0))
    got = spark.createDataFrame([(x,) for x in rows], "c string").select(correction_score(F.col("c")).alias("a"), plain(F.col("c")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    df = spark.range(0, 6000, 1, 1).select(F.concat(F.lit("straße " + "word " * 800), F.col("id").cast("string")).alias("c"))
    assert seconds(df.filter(has_indicators(F.col("c")))) < 0.5 * seconds(df.filter(F.col("c").rlike(long_class)))


def _joined(node):
    """What the sides of a plan's joins have, by name."""
    sides = [node.children().apply(k) for k in range(node.children().size())]
    own = [s.output().mkString(",") for s in sides] if "Join" in node.nodeName() else []
    return own + [x for s in sides for x in _joined(s)]


def test_usual_length_joins_no_texts(spark):
    long, item = "a line of thirty characters ok", "- an item that is of no account at all"
    docs = spark.createDataFrame([(1, "\n".join([long, long + "!", long + "!!", item, "short"])), (2, "tiny")], "doc_id long, text string")
    u = usual_length(text_docset(docs).elements)
    assert {r.doc_id: r.usual for r in u.collect()} == {1: 31.0}
    sides = _joined(u._jdf.queryExecution().sparkPlan())
    assert sides and not any(n in s for s in sides for n in ("content#", "line#"))


def test_cleaning_equals_patterns(spark):
    texts = [None, "", " a  b\t\n c \r\n", "x\x85y\x96z", "ＡＢＣ１２，！", "中 文　字。 x", "f^{^{\\prime}} g^{\\prime}", "é  ñ", "　", "a  b", "\x01a\x7f"]
    old = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")

    def plain(c):
        c = F.translate(X.drop_control_chars(c), "".join(X._C1), "".join(X._C1.values()))
        c = X.close_cjk_gaps(F.translate(c, "".join(X._WIDE), "".join(X._WIDE.values())))
        c = F.regexp_replace(F.regexp_replace(c, r"\^\{\^\{\\prime\}\}", "'"), r"\^\{\\prime\}", "'")
        return old(F.regexp_replace(c, "(?U)" + X.BLANK, " "))

    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select(X.clean(F.col("c")).alias("a"), plain(F.col("c")).alias("b")).collect():
        assert r.a == r.b


def test_context_moves_no_long_texts_and_goes_over_a_page_once(spark):
    page = lambda n: text_docset(spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit("Title "), k.cast("string"))).otherwise(F.repeat(F.lit("long text "), 20))), "\n").alias("text")))
    d = page(12)
    got = {int(r.seq): (r.prev_text, r.next_text) for r in fallback_candidates(d).collect()}
    long = ("long text " * 20)[:79] + "…"
    assert got == {0: ("", long), 4: (long, long), 8: (long, long)}
    plan = fallback_candidates(d)._jdf.queryExecution().optimizedPlan()
    windows = []

    def walk(node):
        if "Window" in node.nodeName():
            windows.append(node.children().apply(0).output().mkString(","))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    # Font statistics have windows of their own.
    assert any("__said" in x for x in windows) and not any("__said" in x and "content#" in x for x in windows)
    one = lambda n: fallback_candidates(d.with_elements(page(n).elements.withColumn("page_number", F.lit(1))))
    assert seconds(one(32000)) < 10 * seconds(one(4000))


def test_cutting_looks_at_the_beginning(spark):
    texts = [None, "", " ", "\n" * 500 + "a", "x" * 80, "x" * 81, " a\n\n b " * 9, "a \r\n" * 200, " " * 319 + "ab", "b" * 79 + " " * 300 + "c", "c" * 70 + " " * 245 + "\r\nddd" + "e" * 400, "\x1c" * 400 + "z"]
    flat = compact(F.col("c"))
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select(truncate(F.col("c"), 80).alias("a"), F.when(F.length(flat) <= 80, flat).otherwise(F.concat(F.substring(flat, 1, 79), F.lit("…"))).alias("b")).collect():
        assert r.a == r.b
