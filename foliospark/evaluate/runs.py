"""Runs over many documents: averages, comparisons, tools, and the gate against the best so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.headings import warning_code, warning_label

#: Metrics and whether more is better.
METRICS = {"edit_distance": False, "char_f1": True, "heading_f1": True, "cell_f1": True}
TOLERANCE = 0.005


def averages(results: DataFrame, by: str = "document_name") -> DataFrame:
    """Each document's metrics and a last row without a name for all; averages of no document are null."""
    return results.rollup(by).agg(*(F.round(F.avg(m), 4).alias(m) for m in METRICS), F.count("*").alias("documents"))


def summarize_warnings(warnings: DataFrame) -> DataFrame:
    """(code, label, n) of warnings by category, the most frequent first."""
    return warnings.select(warning_code(F.col("warning")).alias("code")).groupBy("code").agg(F.count("*").alias("n")).withColumn("label", warning_label(F.col("code"))).select("code", "label", "n").orderBy(F.desc("n"), "label", "code")


def theme_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme")


def compare(a: DataFrame, b: DataFrame, by: str = "document_name") -> DataFrame:
    """(by, status, and for each metric a, b, delta, verdict): documents of two runs side by side; those of one alone have status only_a or only_b."""
    x = a.select(by, *(F.col(m).alias(f"{m}_a") for m in METRICS), F.lit(True).alias("__a"))
    y = b.select(by, *(F.col(m).alias(f"{m}_b") for m in METRICS), F.lit(True).alias("__b"))
    j = x.join(y, by, "full")
    status = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("both")
    out = [F.col(by), status.alias("status")]
    for m, more in METRICS.items():
        delta = F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6)
        good = delta > 0 if more else delta < 0
        out += [F.col(f"{m}_a"), F.col(f"{m}_b"), delta.alias(f"{m}_delta"), F.when(delta.isNull(), None).when(delta == 0, "same").when(good, "improved").otherwise("regressed").alias(f"{m}_verdict")]
    return j.select(*out)


def verdict_counts(compared: DataFrame) -> DataFrame:
    """(metric, improved, regressed, same) over the documents both runs have."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_verdict").alias("v")) for m in METRICS))
    e = compared.filter("status = 'both'").select(F.explode(rows).alias("x")).select("x.metric", "x.v")
    return e.groupBy("metric").agg(*(F.sum((F.col("v") == k).cast("int")).alias(k) for k in ("improved", "regressed", "same")))


def gate(current: DataFrame, baseline: DataFrame, by: str = "document_name", tolerance: float = TOLERANCE) -> DataFrame:
    """(by, metric, current, baseline, status): ok within tolerance, else improved or regression; missing scores count 0."""
    long = lambda df, name: df.select(by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 3).alias(name)) for m in METRICS))).alias("x")).select(by, "x.*")
    j = long(current, "current").join(long(baseline, "baseline"), [by, "metric"], "left").fillna(0.0, ["current", "baseline"])
    gain = F.when(F.col("metric") == "edit_distance", F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    return j.withColumn("status", F.when(gain < -tolerance, "regression").when(gain > tolerance, "improved").otherwise("ok"))


def best_of(current: DataFrame, baseline: DataFrame, by: str = "document_name") -> DataFrame:
    """The better of both scores for each metric: the next baseline."""
    x = current.select(by, *(F.col(m).alias(f"{m}_c") for m in METRICS)).join(baseline.select(by, *(F.col(m).alias(f"{m}_b") for m in METRICS)), by, "full")
    return x.select(by, *((F.greatest if more else F.least)(f"{m}_c", f"{m}_b").alias(m) for m, more in METRICS.items()))


def tool_scores(documents: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame, str], DataFrame], expected: DataFrame | None = None, by: str = "document_name") -> DataFrame:
    """(tool, by, status, metrics): every tool on every document; status is ok, artifact_only where nothing is expected, or error where the tool gave nothing.

    A tool takes documents and returns (by, output).
    """
    out = None
    names = documents.select(by)
    for name, tool in tools.items():
        made = tool(documents)
        # Texts move once, to be scored; the status needs to know only which there are.
        rows = names.join(made.select(by, F.col("output").isNotNull().alias("__made")), by, "left")
        if expected is None:
            status, pairs = F.when(F.col("__made"), "artifact_only").otherwise("error"), names.join(made.filter("output is not null"), by).withColumn("expected", F.lit(None).cast("string")).filter("false")
        else:
            rows = rows.join(expected.select(by, F.col("expected").isNotNull().alias("__wanted")), by, "left")
            status = F.when(F.col("__made") & F.col("__wanted"), "ok").when(F.col("__made"), "artifact_only").otherwise("error")
            pairs = names.join(made.filter("output is not null"), by).join(expected.filter("expected is not null"), by)
        scored = score(pairs.select(by, "output", "expected"), by)
        part = rows.select(F.lit(name).alias("tool"), by, status.alias("status")).join(scored, by, "left")
        out = part if out is None else out.unionByName(part)
    return out


def tool_summary(scores: DataFrame) -> DataFrame:
    """(tool, documents, ok, and the averages of metrics over those that are ok)."""
    have = [m for m in METRICS if m in scores.columns]
    return scores.groupBy("tool").agg(F.count("*").alias("documents"), F.sum((F.col("status") == "ok").cast("int")).alias("ok"), *(F.round(F.avg(m), 4).alias(m) for m in have))


def report(results: DataFrame, title: str = "Evaluation", by: str = "document_name") -> str:
    """A Markdown report: a row for each document and one for all. The documents of an evaluation set come to the driver, as lines of the report do."""
    rows = averages(results, by).orderBy(F.col(by).asc_nulls_last()).collect()
    show = lambda v: "-" if v is None else f"{v:.3f}"
    head = ["document", *METRICS]
    out = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    out += ["| " + " | ".join([str(r[by]) if r[by] is not None else "**average**", *(show(r[m]) for m in METRICS)]) + " |" for r in rows]
    return "\n".join(out) + "\n"
