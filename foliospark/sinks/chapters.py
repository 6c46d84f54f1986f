"""Documents as chapters with an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import first_line
from foliospark.model import DocSet
from foliospark.sinks.markdown import render, render_pages

PREFACE, INDEX = "前言", "# 目录"


def chapter_elements(elements: DataFrame) -> DataFrame:
    """Elements with their ``chapter``, from 1, and its title: headings of level 1 begin one, what comes before is a preface. Without such headings all is one chapter, named by the first heading; documents without headings have none."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "seq")
    doc = Window.partitionBy("doc_id")
    top = F.when(F.col("heading_level") == 1, 1).otherwise(0)
    e = elements.withColumn("__k", F.sum(top).over(w)).withColumn("__tops", F.sum(top).over(doc)).withColumn("__least", F.min("__k").over(doc))
    line = first_line(F.col("content"))
    opening = F.first(F.when(F.col("heading_level") > 0, line), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.first(F.when(F.col("heading_level") == 1, line), True).over(Window.partitionBy("doc_id", "__k").orderBy("page_number", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = e.withColumn("__opening", opening).filter("__opening is not null")
    title = F.when(F.col("__tops") == 0, F.col("__opening")).when(F.col("__k") == 0, PREFACE).otherwise(own)
    return e.withColumn("chapter_title", title).withColumn("chapter", (F.col("__k") - F.col("__least") + 1).cast("int")).drop("__k", "__tops", "__least", "__opening")


def rebase_images(markdown, folder: str = "images"):
    """Image links as seen from a folder further down."""
    return F.regexp_replace(markdown, rf"(!\[[^\]]*\]\()\Q{folder}\E/", f"$1../{folder}/")


def render_chapters(elements: DataFrame, image_folder: str = "images") -> DataFrame:
    """(doc_id, chapter, title, file, markdown)."""
    e = chapter_elements(elements)
    pages = render_pages(e, ("doc_id", "chapter", "chapter_title"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "markdown"))), lambda x: x.markdown), "\n\n")
    return pages.groupBy("doc_id", "chapter", F.col("chapter_title").alias("title")).agg(rebase_images(body, image_folder).alias("markdown")).withColumn("file", F.concat(F.lit("ch_"), F.when(F.col("chapter") < 10, F.lpad(F.col("chapter").cast("string"), 2, "0")).otherwise(F.col("chapter").cast("string")), F.lit(".md"))).select("doc_id", "chapter", "title", "file", "markdown")


def toc_index(elements: DataFrame) -> DataFrame:
    """(doc_id, index): a link for each chapter, and below it its further headings, indented by level."""
    e = chapter_elements(elements)
    name = F.when(F.col("chapter") < 10, F.lpad(F.col("chapter").cast("string"), 2, "0")).otherwise(F.col("chapter").cast("string"))
    links = e.groupBy("doc_id", "chapter", "chapter_title").agg(F.lit(0).alias("page_number")).select("doc_id", "chapter", F.lit(0).alias("page_number"), F.lit(-1.0).alias("seq"), F.concat(F.lit("- ["), "chapter_title", F.lit("](chapters/ch_"), name, F.lit(".md)")).alias("line"))
    subs = e.filter("heading_level >= 2").select("doc_id", "chapter", "page_number", F.col("seq").cast("double").alias("seq"), F.concat(F.expr("repeat('  ', heading_level - 1)"), F.lit("- "), first_line(F.col("content"))).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "page_number", "seq", "line"))), lambda x: x.line)
    return links.unionByName(subs).groupBy("doc_id").agg(F.concat(F.lit(INDEX + "\n\n"), F.array_join(ordered, "\n"), F.lit("\n")).alias("index"))


def write(d: DocSet, folder: str, chapters: bool = True) -> None:
    """Tables of Markdown below folder: documents, chapters and indexes, one row each."""
    render(d).write.mode("overwrite").parquet(f"{folder}/documents")
    if chapters:
        render_chapters(d.elements).write.mode("overwrite").parquet(f"{folder}/chapters")
        toc_index(d.elements).write.mode("overwrite").parquet(f"{folder}/index")


def write_files(d: DocSet, folder: str, chapters: bool = True) -> DataFrame:
    """``<doc_id>/output.md``, ``index.md`` and ``chapters/ch_NN.md`` written by executors into folder, a URI that all reach; (path, bytes) of each."""
    rows = render(d).select("doc_id", F.lit("output.md").alias("name"), "markdown")
    if chapters:
        rows = rows.unionByName(render_chapters(d.elements).select("doc_id", F.concat(F.lit("chapters/"), "file").alias("name"), "markdown")).unionByName(toc_index(d.elements).select("doc_id", F.lit("index.md").alias("name"), F.col("index").alias("markdown")))

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                path, data = f"{base}/{r.doc_id}/{r.name}", r.markdown.encode()
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(data)
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.mapInPandas(run, "path string, bytes long")
