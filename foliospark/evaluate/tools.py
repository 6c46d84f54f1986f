"""Several tools on the same files: their Markdown, what it scores, a report and a manifest.

A tool takes files (document_name, path, content) and returns (document_name, output): null where it gave nothing.
"""

from __future__ import annotations

import pathlib
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.evaluate.metrics import evaluate
from foliospark.evaluate.runs import METRICS, tool_scores, tool_summary
from foliospark.runtime import materialise
from foliospark.sources.files import READERS, binary_docset, ground_truth

Tool = Callable[[DataFrame], DataFrame]


def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """(document_name, path, content) of each ``<name>/input.*`` below folder; of several of a name the first by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "input.*").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias("document_name"), "path", "content")
    return named.groupBy("document_name").agg(F.min_by(F.struct("path", "content"), "path").alias("f")).select("document_name", "f.path", "f.content")


def _each(one: Callable[[bytes, str], str]) -> Tool:
    def tool(files: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    try:
                        out.append(one(bytes(r.content), r.path))
                    except Exception:
                        # Counts as an error of the tool.
                        out.append(None)
                yield pd.DataFrame({"document_name": pdf["document_name"], "output": pd.Series(out, dtype=object, index=pdf.index)})

        return files.select("document_name", "path", "content").mapInPandas(run, "document_name string, output string")

    return tool


def plain_markdown(content: bytes, path: str) -> str:
    """A file's elements as they are read, one below the other, without any stage."""
    _, elements = READERS[path.rpartition(".")[2].lower()](content, path)
    parts = (("#" * int(e.get("heading_level") or 0) + " ").lstrip() + (e["content"] or "").strip() for e in elements if e["type"] in ("text", "table"))
    return "\n\n".join(p for p in parts if p.strip())


#: Readers alone: what a file says without this library's stages.
plain: Tool = _each(plain_markdown)


def command(args: list[str], timeout: float = 300.0) -> Tool:
    """A program that writes Markdown to its output; ``{}`` among args is the file. It must be on the executors."""

    def one(content: bytes, path: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            file = pathlib.Path(folder, path.rpartition("/")[2])
            file.write_bytes(content)
            return subprocess.run([str(file) if a == "{}" else a for a in args], capture_output=True, text=True, timeout=timeout, check=True).stdout

    return _each(one)


def own(config=None) -> Tool:
    """All of this library's stages."""

    def tool(files: DataFrame) -> DataFrame:
        from foliospark.plans.pipeline import parse_result, prepared

        # Files are named one by one: an evaluation set is small.
        names = {r.path: r.document_name for r in files.select("path", "document_name").collect()}
        spark = files.sparkSession
        d = prepared(binary_docset(spark, list(names))) if names else None
        if d is None:
            return files.select("document_name", F.lit(None).cast("string").alias("output"))
        named = d.docs.join(files.select("document_name", F.col("path").alias("source_path")), "source_path").select("doc_id", "document_name")
        return parse_result(d, config).markdown.join(named, "doc_id").select("document_name", F.col("markdown").alias("output"))

    return tool


def settings(config, source: str | None = None, overrides: list[str] | None = None) -> list[tuple[str, str]]:
    """What a report says of how a run was set up: where settings come from, those overridden, and each one, services as on or off."""

    def shown(value) -> str:
        if isinstance(value, bool):
            return "on" if value else "off"
        if value is None or callable(value) or isinstance(value, DataFrame):
            return "off" if value is None else "on"
        return ", ".join(sorted(map(str, value))) or "(none)" if isinstance(value, set | frozenset) else str(value)

    return [("config source", source or "defaults"), ("overrides", ", ".join(overrides or []) or "(none)"), *((f.name.replace("_", " "), shown(getattr(config, f.name))) for f in fields(config))]


def settings_section(title: str, rows: list[tuple[str, str]]) -> str:
    return "\n".join([f"## {title}", "", *(f"- {k}: `{v}`" for k, v in rows), ""]) if rows else ""


def evaluate_tools(spark: SparkSession, folder: str, tools: dict[str, Tool], include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, outputs): every tool on every file below folder; (tool, document_name, status, metrics) and (tool, document_name, output).

    Documents without an ``expected.md`` have outputs and no scores. Each tool runs once.
    """
    files = input_files(spark, folder)
    files = files if include is None else files.filter(F.col("document_name").isin(*include))
    files = materialise(files, "files")
    made = {name: materialise(files.select("document_name").join(tool(files).select("document_name", "output"), "document_name", "left"), "output") for name, tool in tools.items()}
    score = lambda pairs, by: evaluate(pairs, by).select(by, *METRICS)
    scores = tool_scores(files.select("document_name"), {n: (lambda _, out=out: out) for n, out in made.items()}, score, ground_truth(spark, folder))
    outputs = None
    for name, out in made.items():
        part = out.select(F.lit(name).alias("tool"), "document_name", "output")
        outputs = part if outputs is None else outputs.unionByName(part)
    return scores, outputs


def tools_report(scores: DataFrame, rows: list[tuple[str, str]] | None = None, title: str = "Tools") -> str:
    """A Markdown report: settings, a row for each tool, then one for each document and tool. An evaluation set's rows come to the driver."""
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", "", settings_section("Settings", rows or [])]
    for heading, table, columns in (("By tool", tool_summary(scores).orderBy("tool"), ["tool", "documents", "ok", *METRICS]), ("By document", scores.orderBy("document_name", "tool"), ["document_name", "tool", "status", *METRICS])):
        out += [f"## {heading}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in table.collect()] + [""]
    return "\n".join(out)


def write_evaluation(scores: DataFrame, outputs: DataFrame, folder: str) -> None:
    """``outputs`` by tool as Parquet, and ``manifest``, a line of JSON for each tool and document, under folder."""
    outputs.write.mode("overwrite").partitionBy("tool").parquet(f"{folder}/outputs")
    scores.select(F.to_json(F.struct(*scores.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/manifest")


def write_ground_truth(expected: DataFrame, folder: str) -> DataFrame:
    """Write (document_name, expected, meta), meta a JSON string or null, as ``<name>/expected.md`` and ``<name>/meta.json``; (document_name, path) of each.

    The files of a benchmark that was fetched elsewhere; images of its pages can be put beside them. A name must be a single path segment.
    """
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if not r.document_name or "/" in r.document_name or r.document_name in (".", ".."):
                    raise ValueError(f"not a name: {r.document_name!r}")
                store.create_dir(f"{base}/{r.document_name}", recursive=True)
                for name, text in (("expected.md", r.expected), ("meta.json", r.meta)):
                    if text is not None:
                        with store.open_output_stream(f"{base}/{r.document_name}/{name}", compression=None) as f:
                            f.write(text.encode())
                        rows.append((r.document_name, f"{r.document_name}/{name}"))
            yield pd.DataFrame(rows, columns=["document_name", "path"])

    return materialise(expected.select("document_name", "expected", "meta").mapInPandas(run, "document_name string, path string"), "ground-truth")
