"""What queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.model import DocSet, complete
from foliospark.sources.text import text_docset

#: Lines of documents with the layout of grid_elements(): doc_id, page_number, seq, content, x0, y0, x1, y1, fname, fsize, bold.
GRID = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
el AS (SELECT doc_id, CAST(pos // 40 + 1 AS INTEGER) AS page_number, CAST(pos AS DOUBLE) AS seq, content,
  CASE WHEN pos % 2 = 1 THEN 330.0::DOUBLE ELSE 72.0::DOUBLE END AS x0, CAST(30 + 37 * ((pos % 40) // 2) AS DOUBLE) AS y0,
  CASE WHEN pos % 40 = 0 THEN 540.0::DOUBLE ELSE (CASE WHEN pos % 2 = 1 THEN 330.0 ELSE 72.0 END) + 6.0 * least(length(content), 40) END AS x1, CAST(42 + 37 * ((pos % 40) // 2) AS DOUBLE) AS y1,
  CASE WHEN contains(content, '|') THEN 'Courier' ELSE 'Serif' END AS fname, CASE WHEN length(content) <= 12 THEN 18.0::DOUBLE WHEN length(content) <= 40 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS fsize,
  length(content) <= 60 AND regexp_matches(content, '^[A-Z]') AS bold FROM ln)"""
#: The same with headings: level 1 for the shortest lines that aren't empty, 2 for short ones.
HEADED = GRID + """,
hd AS (SELECT *, CASE WHEN length(content) BETWEEN 1 AND 12 THEN 1 WHEN length(content) BETWEEN 13 AND 40 THEN 2 END AS lv FROM el)"""
#: Lines numbered ``page.line`` on odd documents and ``line`` on every other even one; on the rest every second line opens a numbered part.
NUMBERED = GRID + """,
nu AS (SELECT doc_id, page_number, seq, (CASE WHEN doc_id % 2 = 1 THEN page_number || '.' || CAST(seq + 1 AS BIGINT) || ' ' WHEN doc_id % 4 = 2 THEN CAST(CAST(seq + 1 AS BIGINT) AS VARCHAR) || ' ' ELSE '' END) || content AS content FROM el
  UNION ALL SELECT doc_id, page_number, seq - 0.5, CAST(seq AS BIGINT) // 2 + 1 || ' Part of ' || doc_id FROM el WHERE doc_id % 4 = 0 AND CAST(seq AS BIGINT) % 2 = 0)"""
#: The same with a running head and a number at the foot of each page.
RUNNING = GRID + """,
rn AS (SELECT doc_id, page_number, seq, content, y0, y1 FROM el UNION ALL SELECT DISTINCT doc_id, page_number, page_number * 40 - 40.5::DOUBLE, 'Report ' || doc_id % 7 || ', sheet ' || page_number || CASE WHEN doc_id % 3 = 0 AND page_number % 3 = 0 THEN ' (appendix)' ELSE '' END, 8.0::DOUBLE, 20.0::DOUBLE FROM el
  UNION ALL SELECT DISTINCT doc_id, page_number, page_number * 40 - 0.5::DOUBLE, '- ' || page_number || ' -', 770.0::DOUBLE, 782.0::DOUBLE FROM el)"""
BOXES = """bx AS (SELECT vec_id, label AS doc_id, CAST(vec_id % 5 + 1 AS INTEGER) AS page_number, CAST(vec_id AS DOUBLE) AS seq, CASE vec_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END AS type,
  300 + 1000 * CAST(embedding[1] AS DOUBLE) AS x0, 400 + 1000 * CAST(embedding[2] AS DOUBLE) AS y0, 300 + 1000 * CAST(embedding[1] AS DOUBLE) + 20 + 1000 * abs(CAST(embedding[3] AS DOUBLE)) AS x1, 400 + 1000 * CAST(embedding[2] AS DOUBLE) + 20 + 1000 * abs(CAST(embedding[4] AS DOUBLE)) AS y1 FROM embeddings)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DocSet:
    return text_docset(table(spark, sf_dir, "documents"), grid=True)


def headed(spark: SparkSession, sf_dir: str) -> DocSet:
    d = grid(spark, sf_dir)
    n = F.length("content")
    return d.with_elements(d.elements.withColumn("heading_level", F.when(n.between(1, 12), 1).when(n.between(13, 40), 2)))


def running(spark: SparkSession, sf_dir: str) -> DocSet:
    d = grid(spark, sf_dir)
    n = F.col("page_number")
    late = F.when((F.col("doc_id") % 3 == 0) & (n % 3 == 0), " (appendix)").otherwise("")
    edge = lambda seq, text, y: d.pages.select("doc_id", "page_number", seq.cast("double").alias("seq"), F.lit("text").alias("type"), text.alias("content"), F.lit("native").alias("source"), G.box(F.lit(72.0), F.lit(y), F.lit(300.0), F.lit(y + 12)).alias("bbox"))
    head = edge(n * 40 - 40.5, F.concat(F.lit("Report "), (F.col("doc_id") % 7).cast("string"), F.lit(", sheet "), n.cast("string"), late), 8.0)
    foot = edge(n * 40 - 0.5, F.concat(F.lit("- "), n.cast("string"), F.lit(" -")), 770.0)
    return d.with_elements(d.elements.unionByName(complete(head)).unionByName(complete(foot)))


def numbered(spark: SparkSession, sf_dir: str) -> DocSet:
    d = grid(spark, sf_dir)
    line = (F.col("seq") + 1).cast("long").cast("string")
    lead = F.when(F.col("doc_id") % 2 == 1, F.concat(F.col("page_number").cast("string"), F.lit("."), line, F.lit(" "))).when(F.col("doc_id") % 4 == 2, F.concat(line, F.lit(" "))).otherwise("")
    part = F.concat((F.floor(F.col("seq") / 2) + 1).cast("string"), F.lit(" Part of "), F.col("doc_id").cast("string"))
    parts = d.elements.filter("doc_id % 4 = 0 and seq % 2 = 0").select("doc_id", "page_number", (F.col("seq") - 0.5).alias("seq"), F.lit("text").alias("type"), part.alias("content"), F.lit("native").alias("source"), "bbox")
    return d.with_elements(d.elements.withColumn("content", F.concat(lead, F.col("content"))).unionByName(complete(parts)))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda k: F.get("embedding", F.lit(k)).cast("double")
    x0, y0 = 300 + 1000 * v(0), 400 + 1000 * v(1)
    kind = F.when(F.col("vec_id") % 4 == 0, "table").when(F.col("vec_id") % 4 == 1, "image").otherwise("text")
    rows = e.select(F.col("label").cast("long").alias("doc_id"), (F.col("vec_id") % 5 + 1).cast("int").alias("page_number"), F.col("vec_id").cast("double").alias("seq"), F.col("vec_id").cast("string").alias("elem_id"), kind.alias("type"), F.concat(F.lit("box "), F.col("vec_id").cast("string")).alias("content"), F.lit("native").alias("source"), G.box(x0, y0, x0 + 20 + 1000 * F.abs(v(2)), y0 + 20 + 1000 * F.abs(v(3))).alias("bbox"))
    return complete(rows.withColumn("vector_figure", F.col("type") == "image"))


def box_docset(spark: SparkSession, sf_dir: str) -> DocSet:
    e = boxes(spark, sf_dir)
    p = e.select("doc_id", "page_number").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0)).withColumn("page_type", F.lit("native"))
    from foliospark.model import DOC, PAGE

    return DocSet(complete(e.select("doc_id").distinct(), DOC), complete(p, PAGE), e)
