"""Where intermediate tables are kept, and for how long."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliospark.functions.headings import NUMBERING, numbering_signal
from foliospark.functions.text import py_strip
from foliospark.model import complete
from foliospark.operators.chapter import coherent_groups
from foliospark.plans import pipeline
from foliospark.runtime import discard, materialise, shared_folder, void_columns
from foliospark.sources.text import html_docset


def _session(master):
    unset = SimpleNamespace(getOrElse=lambda other: other)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: other))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(_session(master))


def test_tables_are_deleted_when_discarded(spark):
    kept = materialise(spark.range(5), "some")
    path = kept._stored_at.removeprefix("file://")
    assert kept.count() == 5 and os.path.isdir(path) and path.startswith(shared_folder(spark).removeprefix("file://"))
    discard(kept, spark.range(1))
    assert not os.path.exists(path)


def test_columns_without_values_are_not_carried(spark):
    some = spark.range(6).selectExpr("id", "cast(null as int) as a", "'null' as b", "cast(null as array<int>) as c", "cast(null as string) as d")
    other = spark.range(3).selectExpr("id", "cast(null as int) as a", "'x' as b", "array(1) as c", "cast(null as string) as d")
    both = some.join(spark.range(9).withColumnRenamed("id", "k"), some.id == F.col("k"), "left").drop("k").unionByName(other)
    assert void_columns(some) == {"a", "c", "d"} and void_columns(both) == {"a", "d"}
    kept = materialise(both, "narrow", narrow=True)
    assert spark.read.parquet(kept._stored_at).columns == ["id", "b", "c"]
    assert kept.dtypes == both.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, both.collect()))


def test_a_stage_without_work_writes_nothing(spark, monkeypatch):
    from foliospark.plans import pipeline
    from foliospark.sources.text import text_docset

    written = []
    monkeypatch.setattr(pipeline, "STAGES", [(n, s) for n, s in pipeline.STAGES if n in ("recognition", "vlm_review")])
    monkeypatch.setattr(pipeline, "materialise", lambda df, tag, **k: written.append(tag) or materialise(df, tag, **k))
    d = pipeline.parse(text_docset(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), grid=True))
    assert written == ["elements-recognition"] and d.elements.count() == 2


def test_stages_that_read_once_go_with_the_one_before(spark, monkeypatch):
    html = "<h1>1 Head</h1><p>some text that goes</p><p>on here</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table><p>Table 1: a table</p>"
    written = []
    monkeypatch.setattr(pipeline, "materialise", lambda df, tag, **k: written.append(tag) or materialise(df, tag, **k))
    d = pipeline.parse(html_docset(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")), geometry=False)
    assert written == ["elements-recognition", "elements-formula", "elements-text_clean", "elements-crossref"]
    assert [(r.type, r.content.split("\n")[0], r.heading_level, r.caption) for r in d.elements.orderBy("seq").collect()] == [("text", "1 Head", 2, None), ("text", "some text that goes on here", None, None), ("table", "| a |", None, "Table 1: a table"), ("text", "Table 1: a table", None, None)]


def test_numbering_groups_go_over_elements_once(spark):
    rows = [(1, f"{k} Root") for k in (1, 2, 3)] + [(2, f"4.{k} Part") for k in (1, 2, 3)] + [(3, "7 Alone"), (3, "plain"), (3, "１.２ Wide")]
    e = materialise(complete(spark.createDataFrame(rows, "doc_id long, content string").selectExpr("*", "1 page_number", "0d seq", "'text' type")), "numbered")
    g = coherent_groups(e)
    assert {(r.doc_id, r["__of"], r.root) for r in g.collect()} == {(1, None, True), (2, 4, False)}
    assert g._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_signals_by_first_character(spark):
    texts = ["第三章 x", "附录一 x", "十、x", "（二）x", "3) x", "٣) x", "1.2 x", "## 1.2 x", "１.２ x", "*3、x", "x 1", "", None, "#", "(x"]
    plain = lambda t: F.coalesce(*(F.when(t.rlike(regex), name) for name, regex, _ in NUMBERING))
    unmarked = F.translate(F.replace(F.regexp_replace(py_strip(F.col("t")), r"(?U)^\s{0,3}#{1,6}\s*", ""), F.lit("*"), F.lit("")), "．０１２３４５６７８９", ".0123456789")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(numbering_signal(F.col("t")).alias("a"), plain(unmarked).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) == 9
