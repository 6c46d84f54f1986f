"""Text, heading and table scores, and what the largest differences are."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.arrow import shared_chars
from foliospark.functions.let import computed, let
from foliospark.functions.tables import SEPARATOR
from foliospark.functions.text import for_comparison, lines, py_strip, without_space

CHUNK = 5000


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the normal forms against the longer one; 0 for two empty texts. Texts over 5000 characters are compared by as many proportional pieces as that takes, so that cost stays linear."""
    # Normal forms are used many times over, and are worked out once.
    return let(F.struct(for_comparison(a).alias("x"), for_comparison(b).alias("y")), lambda s: _distance(s["x"], s["y"]))


def _distance(x: Column, y: Column) -> Column:
    longest = F.greatest(F.length(x), F.length(y))
    n = F.greatest(F.ceil(longest / CHUNK).cast("int"), F.lit(1))
    sa, sb = F.greatest(F.floor(F.length(x) / n).cast("int"), F.lit(1)), F.greatest(F.floor(F.length(y) / n).cast("int"), F.lit(1))

    def piece(c, step, k):
        return F.substring(c, k * step + 1, F.when(k == n - 1, F.length(c)).otherwise(step))

    def pair(acc, k):
        p, q = piece(x, sa, k), piece(y, sb, k)
        return F.struct((acc["d"] + F.levenshtein(p, q)).alias("d"), (acc["m"] + F.greatest(F.length(p), F.length(q))).alias("m"))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), pair)
    return F.when(longest == 0, 0.0).when(F.least(F.length(x), F.length(y)) == 0, 1.0).otherwise(total["d"] / F.greatest(total["m"], F.lit(1)))


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-10))


def multiset_scores(common: Column, ours: Column, theirs: Column) -> tuple[Column, Column, Column]:
    p, r = common / F.greatest(ours, F.lit(1)), common / F.greatest(theirs, F.lit(1))
    return F.round(p, 4), F.round(r, 4), F.round(_f1(p, r), 4)


def bag_overlap(items_a: DataFrame, items_b: DataFrame, by: str, item: str) -> DataFrame:
    """(by, common, n_a, n_b): how many items two multisets share, counted by grouping each and one join."""
    a = items_a.groupBy(by, item).agg(F.count("*").alias("x"))
    b = items_b.groupBy(by, item).agg(F.count("*").alias("y"))
    return a.join(b, [by, item], "full").groupBy(by).agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("common"), F.sum(F.coalesce("x", F.lit(0))).alias("n_a"), F.sum(F.coalesce("y", F.lit(0))).alias("n_b"))


def text_metrics(pairs: DataFrame, by: str = "document_name") -> DataFrame:
    """(by, edit_distance, char_precision, char_recall, char_f1) of pairs (by, output, expected)."""
    p = computed(pairs.select(by, "output", "expected"), o=for_comparison(F.coalesce("output", F.lit(""))), e=for_comparison(F.coalesce("expected", F.lit("")))).select(by, "o", "e")
    p = p.withColumn("common", shared_chars(F.col("o"), F.col("e")))
    pr, rc, f1 = multiset_scores(F.col("common"), F.length("o"), F.length("e"))
    none = (F.length("o") == 0) & (F.length("e") == 0)
    return p.select(by, _distance(F.col("o"), F.col("e")).alias("edit_distance"), F.when(none, 1.0).otherwise(pr).alias("char_precision"), F.when(none, 1.0).otherwise(rc).alias("char_recall"), F.when(none, 1.0).otherwise(f1).alias("char_f1"))


def headings(markdown: Column) -> Column:
    """array<struct<level int, title string>> of the heading lines of Markdown."""
    hit = F.filter(F.transform(lines(markdown), py_strip), lambda x: x.rlike(r"(?U)^#{1,6}\s+\S"))
    return F.transform(hit, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), py_strip(F.regexp_replace(x, r"(?U)^#{1,6}\s+", "")).alias("title")))


def normal_heading(title: Column) -> Column:
    t = F.translate(without_space(title), "—–－：，", "---:,")
    return F.lower(F.regexp_replace(t, "^[—–一-]{2,}", "--"))


def match_headings(found: list, wanted: list) -> int:
    """How many of found (level, title) match one of wanted, each used once: the same level, and a title that equals, holds or is part of it; the first that fits."""
    used, n = set(), 0
    for level, title in found:
        for k, (lv, t) in enumerate(wanted):
            if k not in used and lv == level and (title in t or t in title):
                used.add(k)
                n += 1
                break
    return n


def heading_metrics(pairs: DataFrame, by: str = "document_name") -> DataFrame:
    """(by, heading_precision, heading_recall, heading_f1, detected, expected_n, correct, applicable); scores are 0 where nothing is expected, and applicable false."""

    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        get = lambda xs: [(x["level"], x["title"]) for x in (xs if xs is not None else [])]
        return pd.Series([match_headings(get(x), get(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    norm = lambda c: F.transform(headings(F.coalesce(c, F.lit(""))), lambda h: F.struct(h.level.alias("level"), normal_heading(h.title).alias("title")))
    p = pairs.select(by, norm(F.col("output")).alias("o"), norm(F.col("expected")).alias("e")).withColumn("correct", F.pandas_udf(count, T.IntegerType())("o", "e"))
    pr, rc, f1 = multiset_scores(F.col("correct"), F.size("o"), F.size("e"))
    some = F.size("e") > 0
    return p.select(by, *(F.when(some, v).otherwise(0.0).alias(n) for v, n in ((pr, "heading_precision"), (rc, "heading_recall"), (f1, "heading_f1"))), F.size("o").alias("detected"), F.size("e").alias("expected_n"), F.when(some, F.col("correct")).otherwise(0).alias("correct"), some.alias("applicable"))


def table_cells(markdown: DataFrame, by: str, column: str) -> DataFrame:
    """(by, table, row, col, cell): cells of the tables of Markdown, numbered from 0 in order; lines in pipes that follow each other are a table, separators aside."""
    ls = markdown.select(by, F.posexplode(F.transform(lines(F.coalesce(column, F.lit(""))), py_strip)).alias("n", "line"))
    piped = ls.withColumn("in", F.col("line").rlike(r"^\|.*\|\z") & (F.length("line") > 1))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("n")
    t = piped.withColumn("brk", F.when(F.col("in"), 0).otherwise(1)).withColumn("grp", F.sum("brk").over(w)).filter(F.col("in") & ~F.col("line").rlike(SEPARATOR))
    t = t.withColumn("table", F.dense_rank().over(Window.partitionBy(by).orderBy("grp")) - 1).withColumn("row", F.row_number().over(Window.partitionBy(by, "grp").orderBy("n")) - 1)
    return t.select(by, "table", "row", F.posexplode(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|", -1)).alias("col", "cell"))


def table_metrics(pairs: DataFrame, by: str = "document_name") -> DataFrame:
    """(by, tables_detected, tables_expected, cell_precision, cell_recall, cell_f1, column_accuracy): tables are paired by number, those over aren't counted."""
    a, b = table_cells(pairs, by, "output"), table_cells(pairs, by, "expected")
    n = lambda t, name: t.groupBy(by).agg(F.count_distinct("table").alias(name))
    counts = pairs.select(by).join(n(a, "tables_detected"), by, "left").join(n(b, "tables_expected"), by, "left").fillna(0)
    both = F.least("tables_detected", "tables_expected")
    cells = lambda t: t.join(counts, by).filter(F.col("table") < both).withColumn("k", F.lower(without_space(F.col("cell")))).filter("k <> ''").select(by, F.concat_ws(":", "table", "k").alias("item"))
    bags = bag_overlap(cells(a), cells(b), by, "item")
    wide = lambda t, name: t.groupBy(by, "table").agg((F.max("col") + 1).alias(name))
    cols = wide(a, "x").join(wide(b, "y"), [by, "table"]).groupBy(by).agg(F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 4).alias("column_accuracy"))
    pr, rc, f1 = multiset_scores(F.col("common"), F.col("n_a"), F.col("n_b"))
    return counts.join(bags, by, "left").join(cols, by, "left").select(by, "tables_detected", "tables_expected", *(F.coalesce(v, F.lit(0.0)).alias(m) for v, m in ((pr, "cell_precision"), (rc, "cell_recall"), (f1, "cell_f1"), (F.col("column_accuracy"), "column_accuracy"))))


def residuals(output: str, expected: str) -> dict:
    """The largest extra and missing stretches of lines and what they look like."""
    import re

    normal = lambda s: " ".join(re.sub(r"<!-- PAGE \d+ -->", "", re.sub(r"^#{1,6}\s+", "", s, flags=re.M)).split())
    solid = lambda s: [x for r in (s or "").splitlines() if (x := r.strip()) and not x.startswith("<!-- PAGE ")]
    a, b = solid(expected), solid(output)
    extra, missing = [], []
    for op, i, j, k, m in difflib.SequenceMatcher(None, [normal(x) for x in a], [normal(x) for x in b], autojunk=False).get_opcodes():
        for into, rows in ((missing, a[i:j]), (extra, b[k:m])):
            if op != "equal" and rows and (n := len(normal("\n".join(rows)))):
                into.append((n, len(rows), "\n".join(rows)))
    best = lambda s: max(s, key=lambda x: x[:2], default=(0, 0, ""))
    cut = lambda s: s if len(s) <= 280 else s[:279] + "…"
    x, y = best(extra), best(missing)
    more, less = cut(x[2]), cut(y[2])
    n, e = len(normal(output or "")), len(normal(expected or ""))
    head = lambda s: any(r.startswith("#") for r in s.splitlines())
    marks = [("output_heavy", n > 1.08 * e), ("output_light", e > 1.08 * n), ("image_reference_markup", "[图片]" in more or "![" in more), ("table_markup_shape", more.count("|") >= 4), ("extra_heading", head(more)), ("missing_table_shape", less.count("|") >= 4), ("missing_heading", head(less))]
    return {"themes": [t for t, on in marks if on], "extra": more, "extra_chars": x[0], "missing": less, "missing_chars": y[0], "extra_blocks": len(extra), "missing_blocks": len(missing)}


def residual_diagnostics(pairs: DataFrame, by: str = "document_name") -> DataFrame:
    """(by, themes, extra, extra_chars, missing, missing_chars, extra_blocks, missing_blocks)."""

    def run(batches):
        for pdf in batches:
            found = [residuals(o, e) for o, e in zip(pdf["output"], pdf["expected"], strict=True)]
            yield pd.concat([pdf[[by]].reset_index(drop=True), pd.DataFrame(found, columns=["themes", "extra", "extra_chars", "missing", "missing_chars", "extra_blocks", "missing_blocks"])], axis=1)

    kind = pairs.schema[by].dataType.simpleString()
    return pairs.select(by, "output", "expected").mapInPandas(run, f"{by} {kind}, themes array<string>, extra string, extra_chars int, missing string, missing_chars int, extra_blocks int, missing_blocks int")


def evaluate(pairs: DataFrame, by: str = "document_name") -> DataFrame:
    """All scores of each pair, a row each."""
    return text_metrics(pairs, by).join(heading_metrics(pairs, by), by).join(table_metrics(pairs, by), by).join(residual_diagnostics(pairs, by), by)
