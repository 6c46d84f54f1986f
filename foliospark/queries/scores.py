"""Rendering, chapters, checks, metrics and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.evaluate import metrics, runs
from foliospark.functions import text as X
from foliospark.queries.base import GRID, HEADED, headed, table
from foliospark.sinks import chapters, markdown
from foliospark.verify import checks

_MD = """,
md AS (SELECT doc_id, page_number, seq, lv, content, CASE WHEN lv IS NOT NULL THEN repeat('#', lv) || ' ' || content ELSE content END AS m FROM hd),
pm AS (SELECT doc_id, page_number, '<!-- PAGE ' || page_number || ' -->' || chr(10) || string_agg(m, chr(10) || chr(10) ORDER BY seq) AS markdown FROM md WHERE m <> '' GROUP BY doc_id, page_number),
dm AS (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page_number) AS markdown FROM pm GROUP BY doc_id)"""


def render_pages(spark, sf_dir):
    """K1-K2: the Markdown of every page."""
    return markdown.render_pages(headed(spark, sf_dir).elements).select("doc_id", "page_number", F.md5("markdown").alias("digest"))


_PAGES = f"WITH {HEADED}{_MD} SELECT doc_id, page_number, md5(markdown) AS digest FROM pm"


def render_documents(spark, sf_dir):
    """K1: the Markdown of every document."""
    return markdown.render(headed(spark, sf_dir)).select("doc_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n"))


_DOCS = f"WITH {HEADED}{_MD} SELECT doc_id, md5(markdown) AS digest, CAST(length(markdown) AS INTEGER) AS n FROM dm"
_CH = _MD + r""",
k AS (SELECT *, sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, seq) AS k, sum(CASE WHEN lv = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS tops, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM md),
l AS (SELECT *, min(k) OVER (PARTITION BY doc_id) AS least, first_value(CASE WHEN lv IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening, first_value(CASE WHEN lv = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, k ORDER BY page_number, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS own FROM k),
c AS (SELECT *, CAST(k - least + 1 AS INTEGER) AS chapter, CASE WHEN tops = 0 THEN opening WHEN k = 0 THEN '前言' ELSE own END AS title FROM l WHERE opening IS NOT NULL)"""


def chapter_files(spark, sf_dir):
    """K6-K7: every chapter, its file and text."""
    c = chapters.render_chapters(headed(spark, sf_dir).elements)
    return c.select("doc_id", "chapter", F.md5("title").alias("title"), "file", F.md5("markdown").alias("digest"))


_FILES = f"""WITH {HEADED}{_CH}, p AS (SELECT doc_id, chapter, title, page_number, '<!-- PAGE ' || page_number || ' -->' || chr(10) || string_agg(m, chr(10) || chr(10) ORDER BY seq) AS markdown FROM c WHERE m <> '' GROUP BY doc_id, chapter, title, page_number)
SELECT doc_id, chapter, md5(title) AS title, 'ch_' || CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter || '.md' AS file, md5(string_agg(markdown, chr(10) || chr(10) ORDER BY page_number)) AS digest FROM p GROUP BY doc_id, chapter, title"""


def toc_index(spark, sf_dir):
    """K8: the index of every document."""
    return chapters.toc_index(headed(spark, sf_dir).elements).select("doc_id", F.md5("index").alias("digest"))


_TOC = f"""WITH {HEADED}{_CH}, i AS (SELECT DISTINCT doc_id, chapter, 0 AS page_number, -1.0 AS seq, '- [' || title || '](chapters/ch_' || CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter || '.md)' AS line FROM c
 UNION ALL SELECT doc_id, chapter, page_number, seq, repeat('  ', lv - 1) || '- ' || t FROM c WHERE lv >= 2)
SELECT doc_id, md5('# 目录' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY chapter, page_number, seq) || chr(10)) AS digest FROM i GROUP BY doc_id"""


def heading_warnings(spark, sf_dir):
    """Warnings of the heading hierarchy."""
    d = headed(spark, sf_dir)
    lv = F.when(F.col("heading_level") == 2, F.when(F.col("seq") % 3 == 0, 4).otherwise(2)).otherwise(F.col("heading_level"))
    return checks.headings(d.elements.withColumn("heading_level", lv)).select("doc_id", "page_number", F.md5("warning").alias("digest"))


_HW = rf"""WITH {HEADED}, h AS (SELECT doc_id, page_number, seq, CASE WHEN lv = 2 AND CAST(seq AS BIGINT) % 3 = 0 THEN 4 ELSE lv END AS lv, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM hd WHERE lv IS NOT NULL),
n AS (SELECT *, lag(lv) OVER w AS before, first_value(lv) OVER w AS root, row_number() OVER w AS at FROM h WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, seq)),
o AS (SELECT n.*, (SELECT arg_max(m.lv, m.at) FROM n m WHERE m.doc_id = n.doc_id AND m.at < n.at AND m.lv <= n.lv - 1) AS par FROM n)
SELECT doc_id, page_number, md5('Page ' || page_number || ': heading level jump from H' || before || ' to H' || lv || ' (' || t || ').') AS digest FROM n WHERE lv > before + 1
UNION ALL SELECT doc_id, page_number, md5('Page ' || page_number || ': orphan H' || lv || ' heading without H' || (lv - 1) || ' parent (' || t || ').') FROM o WHERE lv > 1 AND lv <> root AND coalesce(par <> lv - 1, TRUE)
UNION ALL SELECT doc_id, page_number, md5('Page ' || page_number || ': empty heading detected at level H' || lv || '.') FROM h WHERE t = ''"""


def completeness(spark, sf_dir):
    """What is missing where every third document lost its last page and every fifth its text."""
    d = headed(spark, sf_dir)
    last = d.pages.groupBy("doc_id").agg(F.max("page_number").alias("last"))
    cut = d.elements.join(last, "doc_id").filter(~((F.col("doc_id") % 3 == 0) & (F.col("page_number") == F.col("last")))).drop("last")
    md = markdown.render(d.with_elements(cut)).withColumn("markdown", F.when(F.col("doc_id") % 5 == 0, F.substring("markdown", 1, 60)).otherwise(F.col("markdown")))
    w = checks.completeness(d, md)
    return w.select("doc_id", "warning")


_COMPLETE = rf"""WITH {HEADED}{_MD}, la AS (SELECT doc_id, max(page_number) AS last FROM el GROUP BY doc_id), cut AS (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page_number) AS m FROM pm JOIN la USING (doc_id) WHERE NOT (doc_id % 3 = 0 AND page_number = last) GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(m, 1, 60) ELSE m END AS m FROM cut), sh AS (SELECT doc_id, list_sort(list(DISTINCT page_number)) AS want FROM hd WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id),
j AS (SELECT coalesce(sh.doc_id, m.doc_id) AS doc_id, coalesce(want, []) AS want, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(m, ''), '<!-- PAGE (\d+) -->', 1), lambda x: CAST(x AS INTEGER)))) AS got, coalesce(m, '') AS m FROM sh FULL JOIN m USING (doc_id)),
s AS (SELECT doc_id, length(trim(regexp_replace(regexp_replace(string_agg(content, chr(10) ORDER BY page_number, seq), '(?m)^#{{1,6}}\s+', '', 'g'), '\s+', ' ', 'g'))) AS src FROM hd WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id),
o AS (SELECT s.doc_id, src, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(m, ''), '(?m)^\s*>\s?', '', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'), '<!-- PAGE \d+ -->', '', 'g'), '\s+', ' ', 'g'))) AS o FROM s LEFT JOIN m USING (doc_id))
SELECT doc_id, 'Page marker mismatch: expected ' || len(want) || ' rendered page(s), got ' || len(got) || '.' AS warning FROM j WHERE want <> got
UNION ALL SELECT doc_id, 'Rendered text volume drifted beyond tolerance: source=' || src || ' chars, output=' || o || ' chars.' FROM o WHERE src > 0 AND abs(o - src) / src > 0.2"""


def html_leaks(spark, sf_dir):
    """HTML and internal notes in pages taken for Markdown."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("<table border=1><TABLE>"))).when(F.col("page_id") % 4 == 1, F.concat("html", F.lit(" skip_render "))).otherwise(F.col("html")).alias("markdown"))
    return checks.leaks(p).select("doc_id", "warning")


_LEAKS = r"""WITH m AS (SELECT page_id AS doc_id, regexp_replace(html || CASE page_id % 4 WHEN 0 THEN '<table border=1><TABLE>' WHEN 1 THEN ' skip_render ' ELSE '' END, '(?s)<!--.*?-->', '', 'g') AS b FROM pages)
SELECT doc_id, 'HTML table markup detected in output (' || len(regexp_extract_all(b, '(?i)<table[\s>]')) || ' occurrence(s)).' AS warning FROM m WHERE len(regexp_extract_all(b, '(?i)<table[\s>]')) > 0
UNION ALL SELECT doc_id, 'Placeholder/debug text detected in output: ''skip_render''' FROM m WHERE regexp_matches(b, '\bskip_render\b')"""


def image_links(spark, sf_dir):
    """References and files that lack each other: orders refer to suppliers' images, and half of the files are there."""
    li = table(spark, sf_dir, "lineitem")
    md = li.groupBy((F.col("l_orderkey") % 100).alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("![a](images/"), F.col("l_suppkey").cast("string"), F.lit(".png)")))), "\n").alias("markdown"))
    files = li.filter("l_linenumber = 1").select((F.col("l_orderkey") % 100).alias("doc_id"), F.concat(F.lit("images/"), (F.col("l_suppkey") * 2).cast("string"), F.lit(".png")).alias("path"))
    return checks.image_links(md, files).select("doc_id", "warning")


_LINKS = """WITH r AS (SELECT DISTINCT l_orderkey % 100 AS doc_id, l_suppkey AS k FROM lineitem), f AS (SELECT DISTINCT l_orderkey % 100 AS doc_id, l_suppkey * 2 AS k FROM lineitem WHERE l_linenumber = 1)
SELECT doc_id, 'Image reference ''images/' || k || '.png'' in Markdown but file not found on disk.' AS warning FROM r ANTI JOIN f USING (doc_id, k) UNION ALL SELECT doc_id, 'Image file ''' || k || '.png'' on disk but not referenced in Markdown.' FROM f ANTI JOIN r USING (doc_id, k)"""


def _turn_pairs(spark, sf_dir):
    """Turns with the next of their conversation as what was expected."""
    t = table(spark, sf_dir, "conversations")
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return t.join(n, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("document_name"), F.col("text").alias("output"), "expected")


_TURNS = r"""t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+', '', 'g'), '\s+', ' ', 'g')) AS s, text FROM conversations),
p AS (SELECT a.conv_id || '-' || a.turn AS document_name, a.s AS o, b.s AS e, a.text AS output, b.text AS expected FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def edit_distances(spark, sf_dir):
    """How far each turn is from the next."""
    return _turn_pairs(spark, sf_dir).select("document_name", F.round(metrics.edit_distance(F.col("output"), F.col("expected")), 6).alias("edit_distance"))


#: levenshtein() counts bytes there, so each letter with an accent becomes a byte that no text has.
_ACCENTS = "éèÍÄÊñÉßêçÇíÈÑüöÖóÓäÜáÁúÚ"
_BYTES = "||".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(_ACCENTS)])
_EDIT = f"WITH {_TURNS}, q AS (SELECT document_name, translate(o, '{_ACCENTS}', {_BYTES}) AS o, translate(e, '{_ACCENTS}', {_BYTES}) AS e FROM p) SELECT document_name, CASE WHEN o = '' AND e = '' THEN 0.0::DOUBLE WHEN o = '' OR e = '' THEN 1.0::DOUBLE ELSE round(levenshtein(o, e) / greatest(length(o), length(e)), 6) END AS edit_distance FROM q"


def char_scores(spark, sf_dir):
    """Characters that each turn shares with the next."""
    return metrics.text_metrics(_turn_pairs(spark, sf_dir)).select("document_name", "char_precision", "char_recall", "char_f1")


_CHARS = f"""WITH {_TURNS}, a AS (SELECT document_name, c, count(*) AS n FROM (SELECT document_name, unnest(string_split(o, '')) AS c FROM p WHERE o <> '') GROUP BY ALL), b AS (SELECT document_name, c, count(*) AS n FROM (SELECT document_name, unnest(string_split(e, '')) AS c FROM p WHERE e <> '') GROUP BY ALL),
m AS (SELECT document_name, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (document_name, c) GROUP BY document_name), s AS (SELECT document_name, coalesce(k, 0) / greatest(length(o), 1) AS p, coalesce(k, 0) / greatest(length(e), 1) AS r FROM p LEFT JOIN m USING (document_name))
SELECT document_name, round(p, 4) AS char_precision, round(r, 4) AS char_recall, round(2 * p * r / greatest(p + r, 1e-10), 4) AS char_f1 FROM s"""


def heading_lines(spark, sf_dir):
    """The headings of every rendered document."""
    md = markdown.render(headed(spark, sf_dir))
    h = md.select("doc_id", F.explode(metrics.headings(F.col("markdown"))).alias("h"))
    return h.groupBy("doc_id", "h.level").agg(F.count("*").alias("n"), F.sum(F.length(metrics.normal_heading(F.col("h.title")))).alias("chars"))


_HEADS = rf"""WITH {HEADED}{_MD}, l AS (SELECT doc_id, regexp_replace(unnest(string_split(markdown, chr(10))), '^\s+|\s+$', '', 'g') AS x FROM dm), h AS (SELECT doc_id, CAST(length(regexp_extract(x, '^(#+)', 1)) AS INTEGER) AS level, regexp_replace(x, '^#{{1,6}}\s+', '') AS t FROM l WHERE regexp_matches(x, '^#{{1,6}}\s+\S'))
SELECT doc_id, level, count(*) AS n, CAST(sum(length(regexp_replace(translate(regexp_replace(t, '\s+', '', 'g'), '—–－：，', '---:,'), '^[—–一-]{{2,}}', '--'))) AS BIGINT) AS chars FROM h GROUP BY ALL"""


def table_scores(spark, sf_dir):
    """Tables that documents' lines in pipes make against those of a copy without every third line."""
    d = table(spark, sf_dir, "documents")
    piped = F.transform(F.split("text", "\n"), lambda x: F.when(F.instr(x, "|") > 0, F.concat(F.lit("|"), F.regexp_replace(x, r"^\|+|\|+\z", ""), F.lit("|"))).otherwise(x))
    p = d.filter(F.instr("text", "|") > 0).select(F.col("doc_id").alias("document_name"), F.array_join(piped, "\n").alias("expected"), F.array_join(F.filter(piped, lambda x, i: i % 3 != 2), "\n").alias("output"))
    return metrics.table_metrics(p)


_TABLES = rf"""WITH {GRID}, x AS (SELECT doc_id, seq, CASE WHEN contains(content, '|') THEN '|' || regexp_replace(content, '^\|+|\|+$', '', 'g') || '|' ELSE content END AS l FROM el WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(text, '|'))),
s AS (SELECT doc_id, 'e' AS side, seq, regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM x UNION ALL SELECT doc_id, 'o', seq, regexp_replace(l, '^\s+|\s+$', '', 'g') FROM x WHERE CAST(seq AS BIGINT) % 3 <> 2),
b AS (SELECT *, regexp_matches(l, '^\|.*\|$') AND length(l) > 1 AS t FROM s), g AS (SELECT *, sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, side ORDER BY seq) AS grp FROM b),
r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, side ORDER BY grp) - 1 AS tb FROM g WHERE t AND NOT regexp_matches(l, '^\|?[\s:|-]+(?:\|[\s:|-]+)+\|?$')),
c AS (SELECT doc_id, side, tb, seq, len(string_split(substr(l, 2, length(l) - 2), '|')) AS w, lower(regexp_replace(unnest(string_split(substr(l, 2, length(l) - 2), '|')), '\s+', '', 'g')) AS cell FROM r),
n AS (SELECT d.doc_id, count(DISTINCT tb) FILTER (side = 'o') AS no, count(DISTINCT tb) FILTER (side = 'e') AS ne FROM (SELECT DISTINCT doc_id FROM x) d LEFT JOIN r USING (doc_id) GROUP BY ALL),
k AS (SELECT doc_id, tb, cell, count(*) FILTER (side = 'o') AS a, count(*) FILTER (side = 'e') AS e FROM c JOIN n USING (doc_id) WHERE tb < least(no, ne) AND cell <> '' GROUP BY ALL),
m AS (SELECT doc_id, sum(least(a, e)) AS k, sum(a) AS a, sum(e) AS e FROM k GROUP BY doc_id), w AS (SELECT doc_id, tb, max(w) FILTER (side = 'o') AS x, max(w) FILTER (side = 'e') AS y FROM c GROUP BY ALL), v AS (SELECT doc_id, round(avg(CAST(x = y AS INTEGER)), 4) AS ca FROM w WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY doc_id),
f AS (SELECT n.*, coalesce(k / greatest(a, 1), 0) AS p, coalesce(k / greatest(e, 1), 0) AS q, coalesce(ca, 0) AS ca FROM n LEFT JOIN m USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id AS document_name, no AS tables_detected, ne AS tables_expected, round(p, 4) AS cell_precision, round(q, 4) AS cell_recall, round(2 * p * q / greatest(p + q, 1e-10), 4) AS cell_f1, ca AS column_accuracy FROM f"""


def _results(spark, sf_dir, shift: int, whole: bool = False):
    """Made-up scores of documents, from their numbers: of all, or for runs that share most of them."""
    d = table(spark, sf_dir, "documents").filter(F.lit(whole) | (F.col("doc_id") % 10 != shift))
    s = lambda k: ((F.col("doc_id") * k + shift * 13) % 101) / 101.0
    return d.select(F.col("doc_id").alias("document_name"), *(F.round(s(k), 3).alias(m) for k, m in ((7, "edit_distance"), (11, "char_f1"), (17, "heading_f1"), (23, "cell_f1"))))


def _res(shift: int, whole: bool = False) -> str:
    return "SELECT doc_id AS document_name, " + ", ".join(f"round(((doc_id * {k} + {shift * 13}) % 101) / 101.0::DOUBLE, 3) AS {m}" for k, m in ((7, "edit_distance"), (11, "char_f1"), (17, "heading_f1"), (23, "cell_f1"))) + " FROM documents" + (f" WHERE doc_id % 10 <> {shift}" if not whole else "")


def ab_compare(spark, sf_dir):
    """Documents of two runs side by side."""
    c = runs.compare(_results(spark, sf_dir, 1), _results(spark, sf_dir, 2))
    return c.select("document_name", "status", "char_f1_a", "char_f1_b", "char_f1_delta", "char_f1_verdict", "edit_distance_verdict")


_AB = f"""WITH a AS ({_res(1)}), b AS ({_res(2)})
SELECT document_name, CASE WHEN b.char_f1 IS NULL THEN 'only_a' WHEN a.char_f1 IS NULL THEN 'only_b' ELSE 'both' END AS status, a.char_f1 AS char_f1_a, b.char_f1 AS char_f1_b, round(b.char_f1 - a.char_f1, 6) AS char_f1_delta,
 CASE WHEN round(b.char_f1 - a.char_f1, 6) = 0 THEN 'same' WHEN round(b.char_f1 - a.char_f1, 6) > 0 THEN 'improved' WHEN round(b.char_f1 - a.char_f1, 6) < 0 THEN 'regressed' END AS char_f1_verdict,
 CASE WHEN round(b.edit_distance - a.edit_distance, 6) = 0 THEN 'same' WHEN round(b.edit_distance - a.edit_distance, 6) < 0 THEN 'improved' WHEN round(b.edit_distance - a.edit_distance, 6) > 0 THEN 'regressed' END AS edit_distance_verdict FROM a FULL JOIN b USING (document_name)"""


def regression_gate(spark, sf_dir):
    """A run against the best scores so far."""
    g = runs.gate(_results(spark, sf_dir, 1), runs.best_of(_results(spark, sf_dir, 2), _results(spark, sf_dir, 3)))
    return g.groupBy("metric", "status").agg(F.count("*").alias("n"))


_GATE = f"""WITH a AS ({_res(1)}), b AS ({_res(2)}), c AS ({_res(3)}), m AS (SELECT document_name, least(b.edit_distance, c.edit_distance) AS edit_distance, greatest(b.char_f1, c.char_f1) AS char_f1, greatest(b.heading_f1, c.heading_f1) AS heading_f1, greatest(b.cell_f1, c.cell_f1) AS cell_f1 FROM b FULL JOIN c USING (document_name)),
l AS (SELECT document_name, 'edit_distance' AS metric, coalesce(m.edit_distance, 0) - a.edit_distance AS gain FROM a LEFT JOIN m USING (document_name) UNION ALL SELECT document_name, 'char_f1', a.char_f1 - coalesce(m.char_f1, 0) FROM a LEFT JOIN m USING (document_name) UNION ALL SELECT document_name, 'heading_f1', a.heading_f1 - coalesce(m.heading_f1, 0) FROM a LEFT JOIN m USING (document_name) UNION ALL SELECT document_name, 'cell_f1', a.cell_f1 - coalesce(m.cell_f1, 0) FROM a LEFT JOIN m USING (document_name))
SELECT metric, CASE WHEN gain < -0.005 THEN 'regression' WHEN gain > 0.005 THEN 'improved' ELSE 'ok' END AS status, count(*) AS n FROM l GROUP BY ALL"""


def report_averages(spark, sf_dir):
    """Each document's scores and those of all."""
    return runs.averages(_results(spark, sf_dir, 1, True)).select("document_name", "edit_distance", "char_f1", "documents")


_AVERAGES = f"WITH a AS ({_res(1, True)}) SELECT document_name, round(avg(edit_distance), 4) AS edit_distance, round(avg(char_f1), 4) AS char_f1, count(*) AS documents FROM a GROUP BY ROLLUP (document_name)"


def tool_summary(spark, sf_dir):
    """Three tools that shorten texts, on all documents: how near each comes to the whole."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_name"), "text")
    cut = lambda n: lambda x: x.select("document_name", F.expr(f"substring(text, 1, length(text) - length(text) div {n})").alias("output"))
    tools = {"all": lambda x: x.select("document_name", F.col("text").alias("output")), "half": cut(2), "odd": lambda x: cut(3)(x).filter("document_name % 2 = 1")}
    score = lambda p, by: metrics.text_metrics(p.withColumn("output", X.for_comparison(F.col("output"))), by).select(by, "char_f1")
    s = runs.tool_scores(d, tools, score, d.select("document_name", F.col("text").alias("expected")))
    return s.groupBy("tool", "status").agg(F.count("*").alias("n"), F.round(F.min("char_f1"), 3).alias("least"))


#: A text's beginning has no character that the text lacks, so precision is 1 and recall a matter of lengths.
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '(?m)^#{{1,6}}\s+', '', 'g'), '<!-- PAGE \d+ -->', '', 'g'), '\s+', ' ', 'g'))"
_TOOLS = f"""WITH d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents), t AS (SELECT 'all' AS tool, 'ok' AS status, {_NORMAL.format("text")} AS o, {_NORMAL.format("text")} AS e FROM d UNION ALL SELECT 'half', 'ok', {_NORMAL.format("substr(text, 1, n - n // 2)")}, {_NORMAL.format("text")} FROM d
 UNION ALL SELECT 'odd', CASE WHEN doc_id % 2 = 1 THEN 'ok' ELSE 'error' END, {_NORMAL.format("substr(text, 1, n - n // 3)")}, {_NORMAL.format("text")} FROM d),
f AS (SELECT tool, status, CASE WHEN o = '' AND e = '' THEN 1.0::DOUBLE ELSE round(2 * (length(o) / greatest(length(e), 1)) / greatest(1 + length(o) / greatest(length(e), 1), 1e-10), 4) END AS f1 FROM t)
SELECT tool, status, count(*) AS n, round(min(CASE WHEN status = 'ok' THEN f1 END), 3) AS least FROM f GROUP BY tool, status"""

SCORES = {
    "render_pages": (render_pages, _PAGES), "render_documents": (render_documents, _DOCS), "chapter_files": (chapter_files, _FILES), "toc_index": (toc_index, _TOC), "heading_warnings": (heading_warnings, _HW),
    "completeness": (completeness, _COMPLETE), "html_leaks": (html_leaks, _LEAKS), "image_links": (image_links, _LINKS), "edit_distances": (edit_distances, _EDIT), "char_scores": (char_scores, _CHARS), "heading_lines": (heading_lines, _HEADS),
    "table_scores": (table_scores, _TABLES), "ab_compare": (ab_compare, _AB), "regression_gate": (regression_gate, _GATE), "report_averages": (report_averages, _AVERAGES), "tool_summary": (tool_summary, _TOOLS),
}
