"""Commands: ``python -m foliospark parse|eval|compare|tools|init``; run them by spark-submit on a cluster."""

from __future__ import annotations

import argparse
import shlex
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.evaluate import tools as T
from foliospark.evaluate.metrics import evaluate
from foliospark.evaluate.runs import compare, report, verdict_counts
from foliospark.plans.pipeline import Config, parse_result, read_documents
from foliospark.runtime import materialise
from foliospark.sinks.chapters import write_files
from foliospark.sources.files import elements_docset, ground_truth, include_list, merge_config
from foliospark.sources.text import html_docset, text_docset

_STARTER = "retain: 2\nreading_order: true\nvalue_threshold: 0.25\ndisabled: []\n"


def _load(spark: SparkSession, kind: str, path: str):
    """(documents, whether they have boxes)."""
    if kind == "text":
        return text_docset(spark.read.parquet(path)), False
    if kind == "html":
        return html_docset(spark.read.parquet(path)), False
    if kind == "elements":
        return elements_docset(spark, f"{path}/elements", f"{path}/pages", f"{path}/docs"), True
    return read_documents(spark, path), True


def config_of(path: str | None, overrides: list[str]) -> Config:
    import yaml

    pairs = {k: yaml.safe_load(v) for k, _, v in (o.partition("=") for o in overrides)}
    values = merge_config(path, pairs) if path else pairs
    known = Config.__dataclass_fields__
    if bad := sorted(set(values) - set(known)):
        raise ValueError("unknown settings: " + ", ".join(bad))
    return replace(Config(), **{k: frozenset(v) if k == "disabled" else v for k, v in values.items()})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "eval", "compare"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--kind", choices=("text", "html", "elements", "binary"), default="elements")
        s.add_argument("--config")
        s.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
        s.add_argument("--output", help="a folder all executors reach")
        if name != "parse":
            s.add_argument("--expected", required=True, help="a folder of <name>/expected.md")
            s.add_argument("--include", help="a list of names")
        if name == "compare":
            s.add_argument("--other", action="append", default=[], metavar="KEY=VALUE", help="settings of the second run")
    t = sub.add_parser("tools", help="several tools on the files of a folder of <name>/input.* and <name>/expected.md")
    t.add_argument("input")
    t.add_argument("--command", dest="programs", action="append", default=[], metavar="NAME=PROGRAM", help="a program that writes Markdown; {} is the file")
    t.add_argument("--config")
    t.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    t.add_argument("--include", help="a list of names")
    t.add_argument("--output", help="a folder all executors reach")
    sub.add_parser("init").add_argument("path", nargs="?", default="foliospark.yaml")
    a = p.parse_args(argv)
    if a.command == "init":
        with open(a.path, "x", encoding="utf-8") as f:
            f.write(_STARTER)
        return 0
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    if a.command == "tools":
        config = config_of(a.config, a.set)
        ours = {"plain": T.plain, "stages": T.own(config), **{n: T.command(shlex.split(c)) for n, _, c in (x.partition("=") for x in a.programs)}}
        scores, outputs = T.evaluate_tools(spark, a.input, ours, include_list(a.include) if a.include else None)
        scores = materialise(scores, "scores")
        if a.output:
            T.write_evaluation(scores, outputs, a.output)
        print(T.tools_report(scores, T.settings(config, a.config, a.set)))
        return 0
    docs, boxes = _load(spark, a.kind, a.input)
    found = parse_result(docs, config_of(a.config, a.set), boxes)
    if a.command == "parse":
        if a.output:
            print(write_files(found.documents, a.output).count(), "files")
        found.stats.show(truncate=False)
        return 0
    want = ground_truth(spark, a.expected, include_list(a.include) if a.include else None)

    def scores(markdown):
        named = markdown.join(docs.docs.select("doc_id", F.coalesce(F.element_at(F.split("source_path", "/"), -2), F.col("doc_id").cast("string")).alias("document_name")), "doc_id")
        return evaluate(want.join(named, "document_name").select("document_name", F.col("markdown").alias("output"), "expected"))

    first = scores(found.markdown)
    if a.command == "eval":
        print(report(first))
    else:
        verdict_counts(compare(first, scores(parse_result(docs, config_of(a.config, a.set + a.other), boxes).markdown))).show(truncate=False)
    return 0
