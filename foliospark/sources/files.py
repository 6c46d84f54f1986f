"""Element files, Markdown pairs, and binary documents through optional libraries."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.model import DOC, ELEMENT, PAGE, DocSet, complete
from foliospark.runtime import materialise
from foliospark.sources.docx import read_docx
from foliospark.sources.pdf import read_pdf

FORMATS = ("pdf", "docx", "doc")


def elements_docset(spark: SparkSession, path: str, pages_path: str, docs_path: str | None = None, format: str = "parquet") -> DocSet:
    """Elements that some other tool extracted, as Parquet or JSON files. Boxes of four zeros become null."""
    e = spark.read.format(format).load(path)
    if "bbox" in e.columns:
        e = e.withColumn("bbox", G.null_if_zero(F.col("bbox")))
    p = complete(spark.read.format(format).load(pages_path), PAGE)
    d = spark.read.format(format).load(docs_path) if docs_path else p.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    return DocSet(complete(d, DOC), p, complete(e, ELEMENT))


def write_elements(docs: DocSet, folder: str) -> None:
    docs.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    docs.pages.write.mode("overwrite").parquet(f"{folder}/pages")
    docs.elements.write.mode("overwrite").parquet(f"{folder}/elements")


def source_format(path):
    """The suffix of a path if it is one of FORMATS, else null."""
    s = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return F.when(s.isin(*FORMATS), s)


#: A reader of one format: bytes in, (pages, elements) out as lists of dicts. Whoever has a library for one, or for others, registers it.
READERS: dict[str, Callable[[bytes, str], tuple[list[dict], list[dict]]]] = {"docx": read_docx, "pdf": read_pdf}


def register_reader(suffix: str, reader: Callable[[bytes, str], tuple[list[dict], list[dict]]]) -> None:
    READERS[suffix] = reader


def binary_docset(spark: SparkSession, path: str | list[str], readers: dict | None = None, recursive: bool = True) -> DocSet:
    """PDF, DOCX and DOC files through readers; a file whose format has none raises, as does one of another format.

    Each file is read once, into a row with all its pages and elements, which is written; nothing is collected.
    """
    known = dict(READERS if readers is None else readers)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select(F.xxhash64("path").alias("doc_id"), "path", source_format(F.col("path")).alias("format"), "content")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if r.format not in known:
                    raise ValueError(f"no reader for {r.path}")
                both = [[json.dumps({"doc_id": r.doc_id, **row}) for row in rows] for rows in known[r.format](bytes(r.content), r.path)]
                yield pd.DataFrame({"doc_id": [r.doc_id], "path": [r.path], "format": [r.format], "pages": [both[0]], "elements": [both[1]]})

    read = materialise(files.mapInPandas(parsed, "doc_id long, path string, format string, pages array<string>, elements array<string>"), "files")
    part = lambda name, schema: complete(read.select(F.explode(name).alias("row")).select(F.from_json("row", schema).alias("r")).select("r.*"), schema)
    docs = read.select("doc_id", F.col("path").alias("source_path"), F.col("format").alias("source_format"), F.size("pages").alias("page_count"))
    return DocSet(complete(docs, DOC), part("pages", PAGE), part("elements", ELEMENT).withColumn("bbox", G.null_if_zero(F.col("bbox"))))


def ground_truth(spark: SparkSession, folder: str, include: list[str] | None = None) -> DataFrame:
    """(document_name, expected) of each ``<name>/expected.md`` below folder, of those named in include if given; folder itself may be one."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "expected.md").text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("document_name"), F.col("value").alias("expected"))
    return files if include is None else files.filter(F.col("document_name").isin(*include))


def include_list(path: str) -> list[str]:
    """Names of a list file, one to a line; ``#`` starts a comment."""
    with open(path, encoding="utf-8") as f:
        return [name for line in f if (name := line.split("#", 1)[0].strip())]


def subset_top_n(samples: DataFrame, specs: list[dict], id_col: str = "doc_id", length_col: str = "n_chars") -> DataFrame:
    """(spec, id, rank): for each spec, in order, its ``limit`` longest samples that no spec before took.

    A spec has ``name``, ``where`` (SQL of a sample) and ``limit``. Specs are few; each takes one window over what it filters.
    """
    from pyspark.sql import Window

    taken, out = None, None
    for s in specs:
        rows = samples.filter(s["where"])
        if taken is not None:
            rows = rows.join(taken, id_col, "left_anti")
        # A take by order is a top-k over partitions, not a sort of all.
        best = rows.select(id_col, length_col).orderBy(F.col(length_col).desc(), F.col(id_col)).limit(s["limit"])
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(length_col).desc(), F.col(id_col)))).select(F.lit(s["name"]).alias("spec"), F.col(id_col), "rank")
        out = ranked if out is None else out.unionByName(ranked)
        ids = ranked.select(id_col)
        taken = ids if taken is None else taken.unionByName(ids)
    return out


_FRAGMENTS = {"title": "# {}", "text_block": "{}", "text": "{}", "code_txt": "```\n{}\n```", "equation_isolated": "$$\n{}\n$$", "figure_caption": "*{}*", "table_caption": "**{}**", "list": "{}"}


def annotations_to_markdown(elements: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, markdown) of annotated elements (category, order, text, html), in their order."""
    md = F.when(F.col("category") == "table", F.coalesce("html", "text"))
    for k, form in _FRAGMENTS.items():
        before, after = form.split("{}")
        md = md.when(F.col("category") == k, F.concat(F.lit(before), F.col("text"), F.lit(after)))
    parts = elements.withColumn("md", md).filter(F.length("md") > 0)
    return parts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "md"))), lambda x: x.md), "\n\n").alias("markdown"))


def parse_json(text: str | None) -> dict | list | None:
    """JSON out of a model's answer: as it is, fenced, or the first balanced object or array in it; None if there is none."""
    if not text:
        return None
    body = text.strip()
    fenced = re.search(r"```(?:json)?\s*\n?(.*?)(?:```|\Z)", body, re.S)
    for candidate in (body, fenced and fenced[1].strip()):
        if candidate:
            try:
                found = json.loads(candidate)
                if isinstance(found, dict | list):
                    return found
            except ValueError:
                pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", body):
        try:
            return decoder.raw_decode(body, m.start())[0]
        except ValueError:
            continue
    return None


def parse_json_column(c, schema: str):
    """from_json of a tolerant reading: fences and what surrounds the outermost braces go."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(inner, schema)


def merge_config(path: str, overrides: dict[str, object] | None = None, seen: tuple[str, ...] = ()) -> dict:
    """A YAML file over those it ``extends``, ``${NAME:default}`` filled from the environment, dotted overrides last."""
    import yaml

    full = os.path.abspath(path)
    if full in seen:
        raise ValueError("configuration files extend each other: " + " -> ".join((*seen, full)))
    with open(full, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    base = own.pop("extends", None)
    out = merge_config(os.path.join(os.path.dirname(full), base), None, (*seen, full)) if base else {}

    def deep(a: dict, b: dict) -> dict:
        return {**a, **{k: deep(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    def fill(x):
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), x) if isinstance(x, str) else x

    out = deep(out, own)
    out = fill(out) if not seen else out
    for dotted, value in (overrides or {}).items():
        at = out
        *path_, last = dotted.split(".")
        for k in path_:
            at = at.setdefault(k, {})
        at[last] = value
    return out


__all__ = ["FORMATS", "annotations_to_markdown", "binary_docset", "elements_docset", "ground_truth", "include_list", "merge_config", "parse_json", "parse_json_column", "register_reader", "source_format", "subset_top_n", "write_elements"]
