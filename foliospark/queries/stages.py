"""Whole stages whose rules are folds, and whole runs. Where SQL can't express them, tests hold them against rules of one page or document."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.evaluate import metrics
from foliospark.functions import text as X
from foliospark.functions.html_table import html_table_column
from foliospark.functions.tables import is_degenerate
from foliospark.model import DocSet, complete
from foliospark.operators import chapter, content_value, crossref, formula, line_unwrap
from foliospark.operators import table as tables
from foliospark.plans.pipeline import parse, parse_result
from foliospark.queries.base import GRID, box_docset, grid, numbered, running, table
from foliospark.runtime import materialise
from foliospark.sinks.chapters import render_chapters
from foliospark.sinks.markdown import render
from foliospark.sources.text import html_docset, text_docset


def flagship(spark, sf_dir):
    """Documents unwrapped, cleaned and measured: lines before and after, characters, and how far the text moved."""
    d = table(spark, sf_dir, "documents")
    usual = line_unwrap.usual_length(text_docset(d).elements)
    j = d.select("doc_id", "lang", "text").join(usual, "doc_id", "left")
    u = j.select("doc_id", "lang", "text", X.clean(line_unwrap.unwrap_texts(j)).alias("out"))
    n = lambda c: F.size(F.split(c, "\n"))
    return u.select("doc_id", "lang", n("text").alias("lines"), n("out").alias("paragraphs"), F.length("out").alias("chars"), F.md5("out").alias("digest"))


def html_structure(spark, sf_dir):
    """Blocks of every page by kind."""
    d = html_docset(table(spark, sf_dir, "pages"))
    return d.elements.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count("heading_level").alias("headings"), F.sum(F.length("content")).cast("long").alias("chars"))


def parse_pages(spark, sf_dir):
    """Every web page through all stages that need no boxes."""
    r = render(parse(html_docset(table(spark, sf_dir, "pages")), geometry=False))
    return r.select("doc_id", F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"))


def parse_documents(spark, sf_dir):
    """Every document, with a running head and page numbers, through all stages, rendered, in chapters, and checked."""
    r = parse_result(running(spark, sf_dir))
    ch = r.chapters.groupBy("doc_id").agg(F.count("*").alias("chapters"))
    w = r.warnings.groupBy("doc_id").agg(F.count("*").alias("warnings"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.stats.join(r.markdown, "doc_id", "left").join(ch, "doc_id", "left").join(w, "doc_id", "left").select("doc_id", "pages", "elements", "headings", F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"), n("chapters"), n("warnings"))


def heading_detection(spark, sf_dir):
    """Headings of numbered lines by level."""
    e = chapter.chapters(numbered(spark, sf_dir)).elements
    return e.filter("heading_level is not null").groupBy("doc_id", "heading_level").agg(F.count("*").alias("n"))


def toc_blocks(spark, sf_dir):
    """Tables of contents, made of each document's lines with a number behind."""
    d = grid(spark, sf_dir)
    k = F.col("seq").cast("long")
    c = F.when(k == 0, "Contents").when(k < 6, F.concat("content", F.lit(" .... "), k.cast("string"))).otherwise(F.col("content"))
    # Rows carry what the rule reads and what is asked for.
    e = chapter.toc_blocks(d.with_elements(d.elements.withColumn("content", c).select("doc_id", "page_number", "seq", "type", "content", "heading_level", "toc_header", "toc_entry"))).elements
    return e.groupBy("doc_id").agg(F.sum(F.coalesce("toc_entry", F.lit(False)).cast("long")).alias("entries"), F.max(F.coalesce("toc_header", F.lit(False))).alias("header"))


_TOC = rf"""WITH {GRID}, c AS (SELECT doc_id, seq, trim(CASE WHEN seq < 6 THEN content || ' .... ' || CAST(seq AS BIGINT) ELSE content END) AS t FROM el WHERE seq BETWEEN 1 AND 39),
n AS (SELECT *, regexp_matches(t, '(?:\.{{2,}}|-{{2,}}|—+|…+|\s)\d{{1,4}}\s*$') AS tail FROM c WHERE t <> ''), b AS (SELECT *, length(t) > 80 OR NOT (tail OR coalesce(lag(tail) OVER (PARTITION BY doc_id ORDER BY seq), FALSE)) AS brk FROM n),
e AS (SELECT doc_id, tail FROM b JOIN (SELECT doc_id, coalesce(min(seq) FILTER (brk), 1e9) AS stop FROM b GROUP BY doc_id) USING (doc_id) WHERE seq < stop), s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (tail) >= 2 AS toc FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN toc THEN n ELSE 0 END AS entries, coalesce(toc, FALSE) AS header FROM documents LEFT JOIN s USING (doc_id)"""


def line_unwrapping(spark, sf_dir):
    """Elements left after lines are merged over them."""
    e = line_unwrap.unwrap_elements(grid(spark, sf_dir)).elements
    return e.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


def value_scores(spark, sf_dir):
    """V3-V7: what each line is worth."""
    d = grid(spark, sf_dir)
    # Rows carry what scoring reads.
    e = content_value.content_value(d.with_elements(d.elements.select(*content_value.needed(d.elements)))).elements
    return e.select("doc_id", "page_number", "seq", "value_score", F.coalesce("skip_render", F.lit(False)).alias("dropped"))


def caption_assignment(spark, sf_dir):
    """Boxes of text as captions of images and tables of their page."""
    d = box_docset(spark, sf_dir)
    k = F.col("seq").cast("long")
    c = F.when(k % 4 == 2, F.concat(F.lit("Figure "), k.cast("string"), F.lit(": a box"))).when(k % 4 == 3, F.concat(F.lit("Table "), k.cast("string"), F.lit(": a box"))).otherwise(F.col("content"))
    e = crossref.captions(d.with_elements(d.elements.withColumn("content", c))).elements
    return e.filter("caption is not null").select("doc_id", "page_number", "elem_id", "caption", "caption_kind")


def formula_notation(spark, sf_dir):
    """Every document with notation put in before each line, and its dollar signs as euros: they would open math."""
    d = table(spark, sf_dir, "documents")
    c = F.array_join(F.transform(F.split(F.translate("text", "$", "€"), "\n"), lambda x: F.concat(F.lit("at 30℃, H₂SiCl₂ and 200μL ≥ 5 "), x)), "\n")
    return d.select("doc_id", F.md5(formula.formula_column(c)).alias("digest"))


_NOTATION = r"""SELECT doc_id, md5(array_to_string(list_transform(string_split(replace(text, '$', '€'), chr(10)), lambda x: 'at $30^{\circ}\mathrm{C}$, $\mathrm{H_{2}SiCl_{2}}$ and $200\,\mathrm{\mu L}$ $\ge$ 5 ' || x), chr(10))) AS digest FROM documents"""


def split_tables(spark, sf_dir):
    """T4: orders' line items as tables over pages, joined again."""
    # Orders are brought together once; what follows has them among its keys, and is planned within materialise().
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey")
    row = F.format_string("| %d | %d | %.2f |", "l_linenumber", "l_partkey", "l_quantity")
    t = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("p")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    e = t.select("doc_id", (F.col("p") + 1).alias("page_number"), F.lit(0.0).alias("seq"), F.lit("table").alias("type"), F.concat(F.lit("| line | part | quantity |\n|---|---|---|\n"), "rows").alias("content"), F.expr("named_struct('x0', 50D, 'y0', 50D, 'x1', 550D, 'y1', 750D)").alias("bbox"))
    p = e.select("doc_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    from foliospark.model import DOC, PAGE

    m = tables.merge_cross_page(DocSet(complete(e.select("doc_id").distinct(), DOC), complete(p, PAGE), complete(e))).elements
    return materialise(m.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.max(F.size("merged_from")).alias("pages")), "split-tables")


_SPLIT = """WITH o AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(DISTINCT (l_linenumber - 1) // 3) AS pages FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)
SELECT doc_id, 1::BIGINT AS tables, CASE WHEN pages > 1 THEN n + 1 ELSE 0 END AS rows, CASE WHEN pages > 1 THEN CAST(pages AS INTEGER) END AS pages FROM o"""


def html_tables(spark, sf_dir):
    """Nations as HTML tables with spans, by region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("</td></tr>")))), "")
    t = n.groupBy("r_name").agg(rows.alias("rows"))
    return t.select("r_name", html_table_column(F.concat(F.lit("<table><tr><th colspan=2>"), "r_name", F.lit("</th></tr><tr><th>nation</th><th>key</th></tr>"), "rows", F.lit("</table>"))).alias("markdown"))


_HTML = """SELECT r_name, '| ' || r_name || ' > nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name || '<') AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""


def degenerate_tables(spark, sf_dir):
    """parts' tables of four makes, of which a blank one and an empty form say nothing."""
    k, name = F.col("p_partkey") % 4, F.regexp_replace(F.regexp_replace("p_name", "[0-9]", ""), r"\|", "")
    form = F.concat(F.lit("| Name | Value |\n|---|---|\n| Name | Value |\n| "), F.when(k == 1, "").otherwise(name), F.lit(" | |"))
    c = F.when(k == 0, "| | |\n|---|---|\n| | |").when(k == 3, F.concat(F.lit("| Name | Size |\n|---|---|\n| "), name, F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))).otherwise(form)
    return table(spark, sf_dir, "part").select("p_partkey", is_degenerate(c).alias("degenerate"))


_DEGENERATE = "SELECT p_partkey, p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND trim(regexp_replace(p_name, '[0-9|]', '', 'g')) = '') AS degenerate FROM part"


def evaluation(spark, sf_dir):
    """Every document as rendered against itself without every fourth line."""
    md = render(grid(spark, sf_dir))
    p = md.select(F.col("doc_id").alias("document_name"), F.col("markdown").alias("expected"), F.array_join(F.filter(F.split("markdown", "\n"), lambda x, i: i % 4 != 3), "\n").alias("output"))
    h = metrics.heading_metrics(p).select("document_name", "heading_f1", "detected")
    return h.join(metrics.residual_diagnostics(p).select("document_name", F.size("themes").alias("themes"), "missing_chars", "missing_blocks"), "document_name")


def chapter_sizes(spark, sf_dir):
    """K6 over web pages: their headings make chapters."""
    c = render_chapters(html_docset(table(spark, sf_dir, "pages")).elements)
    return c.select("doc_id", "chapter", F.length("markdown").alias("chars"))


_SQL = {"toc_blocks": _TOC, "formula_notation": _NOTATION, "split_tables": _SPLIT, "html_tables": _HTML, "degenerate_tables": _DEGENERATE}
STAGE_QUERIES = {
    f.__name__: (f, _SQL.get(f.__name__))
    for f in (flagship, html_structure, parse_pages, parse_documents, heading_detection, toc_blocks, line_unwrapping, value_scores, caption_assignment, formula_notation, split_tables, html_tables, degenerate_tables, evaluation, chapter_sizes)
}
