"""Fonts, headers, columns, boxes and headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.model import PAGE, complete
from foliospark.operators import chapter, code_block, content_value, header_footer, image, line_unwrap, metadata, ocr, page, reading_order, vlm_review
from foliospark.queries.base import BOXES, GRID, NUMBERED, RUNNING, box_docset, grid, headed, numbered, running, table
from foliospark.runtime import materialise


def font_mode(spark, sf_dir):
    """M1: characters of each font of each document, and the body's."""
    s = metadata.font_stats(grid(spark, sf_dir).elements)
    return s.select("doc_id", "font.name", "font.size", "font.bold", "chars", "first_page", "first_seq", "is_body")


_FS = GRID + """,
fs AS (SELECT doc_id, fname, fsize, bold, CAST(sum(length(content)) AS BIGINT) AS chars, min(page_number) AS first_page, arg_min(seq, (page_number, seq)) AS first_seq FROM el GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first_page, first_seq) = 1 AS is_body FROM fs)"""
_FONTS = f"WITH {_FS} SELECT doc_id, fname AS name, fsize AS size, bold, chars, first_page, first_seq, is_body FROM fr"


def heading_fonts(spark, sf_dir):
    """M2: fonts that headings may have, by rank."""
    c = metadata.heading_candidates(metadata.font_stats(grid(spark, sf_dir).elements))
    return c.select("doc_id", "font.name", "font.size", "font.bold", "heading_rank")


_HC = _FS + """,
bd AS (SELECT doc_id, fsize AS bsize, bold AS bbold, chars AS bchars FROM fr WHERE is_body),
gr AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id, round(fsize * 2) / 2, bold) AS gchars FROM fr),
hc AS (SELECT doc_id, fname, fsize, bold, row_number() OVER (PARTITION BY doc_id ORDER BY fsize DESC, bold DESC, first_page, first_seq) AS heading_rank FROM gr JOIN bd USING (doc_id)
 WHERE bsize > 0 AND (fsize >= bsize * 1.2 OR (bold AND NOT bbold AND fsize >= bsize)) AND NOT (bchars > 0 AND gchars > bchars * 0.1))"""
_HEADING_FONTS = f"WITH {_HC} SELECT doc_id, fname AS name, fsize AS size, bold, CAST(heading_rank AS INTEGER) AS heading_rank FROM hc"


def repeated_edges(spark, sf_dir):
    """H2-H3: what repeats at the top or bottom of pages that have a running head and a number."""
    return header_footer.repeated_edges(running(spark, sf_dir)).select("doc_id", "side", "text", "pages")


_EDGES = RUNNING + r""",
pg AS (SELECT doc_id, max(page_number) AS n, min(page_number) AS f FROM el GROUP BY doc_id),
ed AS (SELECT doc_id, page_number, CASE WHEN (y0 + y1) / 2 < 792 * 0.08 THEN 'top' WHEN (y0 + y1) / 2 > 792 * (1 - 0.08) THEN 'bottom' END AS side, regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\d+', '#', 'g') AS text FROM rn)"""
_REPEATED = f"WITH {_EDGES} SELECT doc_id, side, text, count(DISTINCT page_number) AS pages FROM ed JOIN pg USING (doc_id) WHERE side IS NOT NULL AND n >= 2 GROUP BY doc_id, side, text, n HAVING count(DISTINCT page_number) >= greatest(2, floor(n * 0.5) + 1)"


def header_footer_removal(spark, sf_dir):
    """H4-H5: how many elements of each document go, and how many of the first page's are kept for its identity."""
    left = header_footer.strip_headers_footers(running(spark, sf_dir)).elements
    # Written, so that it is planned with documents kept together.
    return materialise(left.groupBy("doc_id").agg(F.count("*").alias("left"), F.sum(F.coalesce("retained_identity", F.lit(False)).cast("long")).alias("retained"), F.sum(F.length("content")).cast("long").alias("chars")), "header-footer")


_REMOVAL = f"""WITH {_EDGES}, rp AS (SELECT doc_id, side, text FROM ed JOIN pg USING (doc_id) WHERE side IS NOT NULL AND n >= 2 GROUP BY doc_id, side, text, n HAVING count(DISTINCT page_number) >= greatest(2, floor(n * 0.5) + 1)),
e AS (SELECT doc_id, page_number, seq, content AS c, y0, y1, CASE WHEN (y0 + y1) / 2 < 792 * 0.08 THEN 'top' WHEN (y0 + y1) / 2 > 792 * (1 - 0.08) THEN 'bottom' END AS side FROM rn),
g AS (SELECT e.*, pg.n, pg.f, rp.doc_id IS NOT NULL AS rep, row_number() OVER (PARTITION BY e.doc_id, e.page_number ORDER BY (y0 + y1) / 2 DESC, y1 DESC, seq) AS low,
  regexp_matches(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '^[—\\s-]*\\d{{1,5}}[—\\s-]*$') OR regexp_matches(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '(?i)^[—\\s-]*[cdilmvx]+[—\\s-]*$') OR regexp_matches(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '^[-–—]\\s*\\d+\\s*[-–—]$') AS num
  FROM e JOIN pg USING (doc_id) LEFT JOIN rp ON rp.doc_id = e.doc_id AND rp.side = e.side AND rp.text = regexp_replace(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '\\d+', '#', 'g')),
h AS (SELECT *, n >= 2 AND (rep OR (num AND (coalesce(side, '') = 'bottom' OR low <= 3))) AS gone FROM g),
k AS (SELECT *, gone AND page_number = f AND NOT num AS cand FROM h), r AS (SELECT *, cand AND row_number() OVER (PARTITION BY doc_id, cand ORDER BY length(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) DESC, page_number, seq) <= 2 AS kept FROM k)
SELECT doc_id, count(*) AS "left", CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS retained, CAST(sum(length(c)) AS BIGINT) AS chars FROM r WHERE NOT gone OR kept GROUP BY doc_id"""


def mixed_mono(spark, sf_dir):
    """Lines taken for code in documents that mix type."""
    e = code_block.mark_code(grid(spark, sf_dir)).elements
    return e.groupBy("doc_id").agg(F.sum(F.coalesce("code_block", F.lit(False)).cast("long")).alias("code_lines"), F.count("*").alias("n"))


_CODE = GRID + r""",
mx AS (SELECT doc_id, bool_or(fname = 'Courier') AND bool_or(fname <> 'Courier') AS mixed FROM el GROUP BY doc_id),
cd AS (SELECT el.*, mixed AND fname = 'Courier' AND NOT regexp_matches(content, '^\s*(?:[㐀-䶿一-鿿豈-﫿]|(?:[IVXivx]+|\d+)[.、)]\s|[A-Za-z][.)]\s)') AS code FROM el JOIN mx USING (doc_id))"""
_MONO = f"WITH {_CODE} SELECT doc_id, CAST(sum(CAST(code AS INTEGER)) AS BIGINT) AS code_lines, count(*) AS n FROM cd GROUP BY doc_id"


def code_runs(spark, sf_dir):
    """Code lines of a page that follow each other, as one element."""
    e = code_block.code_blocks(grid(spark, sf_dir)).elements.filter("code_block")
    return e.select("doc_id", "page_number", "seq", F.md5("content").alias("digest"), F.round("bbox.x1", 3).alias("x1"), F.round("bbox.y1", 3).alias("y1"))


_RUNS = f"""WITH {_CODE}, a AS (SELECT *, CASE WHEN code AND coalesce(lag(code) OVER (PARTITION BY doc_id, page_number ORDER BY seq), FALSE) THEN 0 ELSE 1 END AS new FROM cd),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS run FROM a WHERE TRUE)
SELECT doc_id, page_number, min(seq) AS seq, md5(string_agg(regexp_replace(content, '\\s+$', ''), chr(10) ORDER BY seq) || regexp_extract(arg_max(content, seq), '(\\s*)$', 1)) AS digest, round(max(x1), 3) AS x1, round(max(y1), 3) AS y1 FROM b WHERE code GROUP BY doc_id, page_number, run"""


def gutters(spark, sf_dir):
    """Columns that pages have by themselves."""
    c = reading_order.detect_columns(grid(spark, sf_dir))
    return c.select("doc_id", "page_number", *(F.round(n, 4).alias(n) for n in ("gutter_x", "gutter_width", "left_right", "right_right", "confidence")))


_GUTTER = GRID + """,
cb AS (SELECT doc_id, page_number, x0, x1 FROM el WHERE x1 - x0 <= 612 * 0.6 AND x1 - x0 >= 612 * 0.15),
pc AS (SELECT doc_id, page_number FROM cb GROUP BY ALL HAVING count(*) >= 6),
pl AS (SELECT 612 * 0.3 + k * greatest(1.0, 612 / 200) AS x FROM range(0, CAST(floor((612 * 0.7 - 612 * 0.3) / greatest(1.0, 612 / 200)) AS BIGINT) + 1) t(k)),
cn AS (SELECT doc_id, page_number, x, count(*) FILTER (x0 <= x AND x1 >= x) AS n FROM cb JOIN pc USING (doc_id, page_number) CROSS JOIN pl GROUP BY ALL),
bs AS (SELECT doc_id, page_number, arg_min(x, (n, x)) AS bx, min(n) AS bn FROM cn GROUP BY ALL HAVING min(n) <= 2),
sd AS (SELECT doc_id, page_number, bx, bn, max(x1) FILTER (NOT (x0 < bx AND x1 > bx) AND (x0 + x1) / 2 < bx) AS lr, min(x0) FILTER (NOT (x0 < bx AND x1 > bx) AND (x0 + x1) / 2 >= bx) AS rl, max(x1) FILTER ((x0 + x1) / 2 > bx) AS rr,
  count(*) FILTER (NOT (x0 < bx AND x1 > bx) AND (x0 + x1) / 2 < bx) AS ln, count(*) FILTER (NOT (x0 < bx AND x1 > bx) AND (x0 + x1) / 2 >= bx) AS rn FROM cb JOIN bs USING (doc_id, page_number) GROUP BY ALL),
gt AS (SELECT doc_id, page_number, (lr + rl) / 2 AS gutter_x, greatest(rl - lr, 0.0) AS gutter_width, lr AS left_right, coalesce(rr, rl) AS right_right, (CASE WHEN abs((lr + rl) / 2 / 612 - 0.5) > 0.15 THEN 0.7 ELSE 1.0 END) * (CASE WHEN rl - lr < 5 THEN 0.5 ELSE 1.0 END) * (CASE WHEN bn = 0 THEN 1.0 ELSE 0.7 END) AS confidence FROM sd WHERE ln >= 3 AND rn >= 3),
own AS (SELECT * FROM gt WHERE confidence >= 0.6)"""
_GUTTERS = f"WITH {_GUTTER} SELECT doc_id, page_number, round(gutter_x, 4) AS gutter_x, round(gutter_width, 4) AS gutter_width, round(left_right, 4) AS left_right, round(right_right, 4) AS right_right, CAST(round(confidence, 4) AS DOUBLE) AS confidence FROM own"


def page_layouts(spark, sf_dir):
    """R2: with the median gutter tried on the other pages."""
    c = reading_order.page_layout(grid(spark, sf_dir))
    return c.select("doc_id", "page_number", *(F.round(n, 4).alias(n) for n in ("gutter_x", "gutter_width", "left_right", "right_right", "confidence")))


_LAYOUT = _GUTTER + """,
np AS (SELECT doc_id, max(page_number) AS n FROM el GROUP BY doc_id), hn AS (SELECT doc_id, median(gutter_x) AS hint FROM own JOIN np USING (doc_id) GROUP BY doc_id, n HAVING count(*) >= n * 0.4),
ot AS (SELECT el.doc_id, el.page_number, x0, x1, x1 - x0 AS w, (x0 + x1) / 2 AS m, hint FROM el JOIN hn USING (doc_id) ANTI JOIN own ON own.doc_id = el.doc_id AND own.page_number = el.page_number),
oa AS (SELECT doc_id, page_number, hint, count(*) AS n, count(*) FILTER (w <= 612 * 0.6 AND w >= 612 * 0.15) AS c, count(*) FILTER (w < 612 * 0.15) AS t, max(x1) FILTER (w <= 612 * 0.6 AND w >= 61.2 AND NOT (x0 < hint AND x1 > hint) AND m < hint) AS lr, min(x0) FILTER (w <= 612 * 0.6 AND w >= 61.2 AND NOT (x0 < hint AND x1 > hint) AND m >= hint) AS rl, max(x1) FILTER (w <= 612 * 0.6 AND m > hint) AS rr FROM ot GROUP BY ALL),
lay AS (SELECT doc_id, page_number, gutter_x, gutter_width, left_right, right_right, CAST(confidence AS DOUBLE) AS confidence FROM own UNION ALL SELECT doc_id, page_number, hint, greatest(rl - lr, 0), lr, coalesce(rr, hint + 50), 0.5 FROM oa WHERE n >= 2 AND c >= 2 AND t <= c * 1.5 AND lr IS NOT NULL AND rl IS NOT NULL)"""
_LAYOUTS = f"WITH {_LAYOUT} SELECT doc_id, page_number, round(gutter_x, 4) AS gutter_x, round(gutter_width, 4) AS gutter_width, round(left_right, 4) AS left_right, round(right_right, 4) AS right_right, round(confidence, 4) AS confidence FROM lay"


def reading_orders(spark, sf_dir):
    """Each line's place after reading column by column."""
    d = grid(spark, sf_dir)
    e = reading_order.reading_order(d).elements
    return e.select("doc_id", "page_number", "seq", "column", F.round("column_right", 3).alias("column_right"), F.md5("content").alias("digest"))


_ORDER = f"""WITH {_LAYOUT}, c AS (SELECT el.*, gutter_x IS NOT NULL AS has, CASE WHEN gutter_x IS NULL THEN NULL WHEN x1 - x0 > 612 * 0.6 OR (x0 < gutter_x AND x1 > gutter_x) THEN 'full_width' WHEN (x0 + x1) / 2 < gutter_x THEN 'left' ELSE 'right' END AS col, left_right, right_right FROM el LEFT JOIN lay USING (doc_id, page_number)),
z AS (SELECT *, sum(CASE WHEN col = 'full_width' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY seq) - CASE WHEN col = 'full_width' THEN 1 ELSE 0 END AS zone, CASE col WHEN 'full_width' THEN 2 WHEN 'right' THEN 1 ELSE 0 END AS rk FROM c)
SELECT doc_id, page_number, CASE WHEN has THEN CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, rk, y0, x0, seq) - 1 AS DOUBLE) ELSE seq END AS seq, col AS "column", round(CASE col WHEN 'left' THEN left_right WHEN 'right' THEN right_right WHEN 'full_width' THEN greatest(left_right, right_right) END, 3) AS column_right, md5(content) AS digest FROM z"""


def body_band(spark, sf_dir):
    """V1: the band of each page's body text."""
    return content_value.body_band(grid(spark, sf_dir))


_BAND = GRID + r""",
tx AS (SELECT doc_id, page_number, x0, x1, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM el), bt AS (SELECT *, greatest(length(t), 1) AS w FROM tx WHERE length(t) >= 24 OR regexp_matches(t, '[.;?!。！；？]$')),
rn AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, page_number) AS tot, sum(w) OVER (PARTITION BY doc_id, page_number ORDER BY x0) AS r0, sum(w) OVER (PARTITION BY doc_id, page_number ORDER BY x1) AS r1 FROM bt)
SELECT doc_id, page_number, min(x0) FILTER (r0 >= tot * 0.25) AS body_left, min(x1) FILTER (r1 >= tot * 0.75) AS body_right FROM rn GROUP BY ALL"""


def repeated_assets(spark, sf_dir):
    """V2: small images that a page shows twice, with orders as documents, line numbers as pages, suppliers as images."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.lit("image").alias("type"), F.col("l_suppkey").alias("xref"), G.box(F.lit(0), F.lit(0), F.col("l_quantity") * 5, F.col("l_quantity") * 4).alias("bbox"))
    return content_value.repeated_assets(e)


_ASSETS = "SELECT l_orderkey % 500 AS doc_id, l_linenumber AS page_number, l_suppkey AS xref, count(*) AS n FROM lineitem WHERE l_quantity * 5 <= 180 AND l_quantity * 4 <= 180 AND l_suppkey > 0 GROUP BY ALL HAVING count(*) >= 2"


def table_antijoin(spark, sf_dir):
    """Boxes of text that aren't mostly within a table of their page."""
    e = page.drop_text_in_tables(box_docset(spark, sf_dir)).elements
    return e.groupBy("doc_id", "page_number", "type").agg(F.count("*").alias("n"), F.sum(F.col("seq")).cast("long").alias("ids"))


_ANTI = BOXES + """,
ov AS (SELECT DISTINCT t.vec_id FROM bx t JOIN bx b ON b.doc_id = t.doc_id AND b.page_number = t.page_number AND b.type = 'table' WHERE t.type = 'text' AND greatest(least(t.x1, b.x1) - greatest(t.x0, b.x0), 0) * greatest(least(t.y1, b.y1) - greatest(t.y0, b.y0), 0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.5)
SELECT doc_id, page_number, type, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM bx WHERE vec_id NOT IN (FROM ov) GROUP BY ALL"""


def figure_containment(spark, sf_dir):
    """Boxes of text whose centre lies in a figure, padded."""
    return ocr.text_in_figures(box_docset(spark, sf_dir).elements)


_CONTAIN = BOXES + """
SELECT DISTINCT t.doc_id, CAST(t.vec_id AS VARCHAR) AS elem_id FROM bx t JOIN bx f ON f.doc_id = t.doc_id AND f.page_number = t.page_number AND f.type = 'image' AND t.type = 'text'
 WHERE (t.x0 + t.x1) / 2 BETWEEN f.x0 - (f.x1 - f.x0) * 0.1 AND f.x1 + (f.x1 - f.x0) * 0.1 AND (t.y0 + t.y1) / 2 BETWEEN f.y0 - (f.y1 - f.y0) * 0.1 AND f.y1 + (f.y1 - f.y0) * 0.1"""


def nearest_figure(spark, sf_dir):
    """The figure nearest to each box of text taken for a figure's title."""
    e = box_docset(spark, sf_dir).elements
    return ocr.nearest_figures(e.withColumn("layout_type", F.when(F.col("type") == "text", "figure_title"))).select("doc_id", "cap_id", "fig_id")


_NEAREST = BOXES + """,
p AS (SELECT c.doc_id, CAST(c.vec_id AS VARCHAR) AS cap_id, CAST(f.vec_id AS VARCHAR) AS fig_id, f.seq AS fs, (CASE WHEN f.y1 <= c.y0 + 20 THEN c.y0 - f.y1 ELSE abs(c.y0 - f.y1) + 500 END) + 0.3::DOUBLE * abs((c.x0 + c.x1) / 2 - (f.x0 + f.x1) / 2) AS d FROM bx c JOIN bx f ON f.doc_id = c.doc_id AND f.page_number = c.page_number AND f.type = 'image' AND c.type = 'text')
SELECT doc_id, cap_id, arg_min(fig_id, (d, fs)) AS fig_id FROM p GROUP BY ALL"""


def image_evidence(spark, sf_dir):
    """How much of each image other boxes of its page say, and how many."""
    d = box_docset(spark, sf_dir)
    e = image.evidence(d.with_elements(d.elements.withColumn("vector_figure", F.lit(False))))
    return e.select("doc_id", "elem_id", F.round("best_overlap", 4).alias("best_overlap"), F.size(F.split("text", "\n")).alias("n"), F.col("table_text").contains("box").alias("has_table"))


_EVIDENCE = BOXES + """,
p AS (SELECT i.doc_id, i.vec_id, t.type, greatest(least(t.x1, i.x1) - greatest(t.x0, i.x0), 0) * greatest(least(t.y1, i.y1) - greatest(t.y0, i.y0), 0) / least(greatest((t.x1 - t.x0) * (t.y1 - t.y0), 1), greatest((i.x1 - i.x0) * (i.y1 - i.y0), 1)) AS o FROM bx i JOIN bx t ON t.doc_id = i.doc_id AND t.page_number = i.page_number AND i.type = 'image' AND t.type <> 'image')
SELECT doc_id, CAST(vec_id AS VARCHAR) AS elem_id, round(max(o), 4) AS best_overlap, CAST(count(*) AS INTEGER) AS n, bool_or(type = 'table') AS has_table FROM p WHERE o > 0 GROUP BY ALL"""


def region_assignment(spark, sf_dir):
    """Which image, as a region, each box of text falls in or near."""
    e = box_docset(spark, sf_dir).elements
    r = e.filter("type = 'image'").select("doc_id", "page_number", F.col("seq").cast("long").alias("region"), "bbox")
    return ocr.assign_regions(e.filter("type = 'text'"), r)


_REGION = BOXES + """,
p AS (SELECT t.doc_id, t.page_number, CAST(t.vec_id AS VARCHAR) AS elem_id, i.vec_id AS region, (t.x0 + t.x1) / 2 BETWEEN i.x0 AND i.x1 AND (t.y0 + t.y1) / 2 BETWEEN i.y0 AND i.y1 AS ins, sqrt(pow((t.x0 + t.x1) / 2 - (i.x0 + i.x1) / 2, 2) + pow((t.y0 + t.y1) / 2 - (i.y0 + i.y1) / 2, 2)) AS d FROM bx t JOIN bx i ON i.doc_id = t.doc_id AND i.page_number = t.page_number AND i.type = 'image' AND t.type = 'text')
SELECT doc_id, page_number, elem_id, arg_min(region, (CASE WHEN ins THEN 0 ELSE 1 END, CASE WHEN ins THEN 0 ELSE d END, region)) AS region FROM p GROUP BY ALL"""


def page_classes(spark, sf_dir):
    """The kind of each page of boxes, which are short of text."""
    d = page.classify_pages(box_docset(spark, sf_dir))
    return d.pages.select("doc_id", "page_number", "page_type")


_CLASSES = BOXES + """,
pg AS (SELECT doc_id, page_number, sum(length('box ' || vec_id)) FILTER (type = 'text') AS chars, sum((x1 - x0) * (y1 - y0)) FILTER (type = 'image') AS img, max((x1 - x0) * (y1 - y0)) FILTER (type = 'image') AS big, arg_max(vec_id, ((x1 - x0) * (y1 - y0), -seq)) FILTER (type = 'image') AS bid FROM bx GROUP BY ALL),
ins AS (SELECT pg.doc_id, pg.page_number, sum(length('box ' || t.vec_id)) AS n FROM pg JOIN bx b ON b.vec_id = pg.bid JOIN bx t ON t.doc_id = pg.doc_id AND t.page_number = pg.page_number AND t.type = 'text' AND (t.x0 + t.x1) / 2 BETWEEN b.x0 AND b.x1 AND (t.y0 + t.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN coalesce(chars, 0) < 50 AND coalesce(img, 0) / 480000 > 0.5 THEN 'scanned' WHEN coalesce(big, 0) / 480000 > 0.5 AND coalesce(chars, 0) > 0 AND coalesce(n, 0) > 0.7 * chars THEN 'scanned' WHEN coalesce(chars, 0) < 200 AND coalesce(img, 0) / 480000 > 0.3 THEN 'mixed' ELSE 'native' END AS page_type FROM pg LEFT JOIN ins USING (doc_id, page_number)"""


def pages_to_read(spark, sf_dir):
    """Pages to recognise, those with two columns perhaps, and those to review."""
    d = grid(spark, sf_dir)
    d = d.with_pages(d.pages.withColumn("page_type", F.when(F.col("doc_id") % 3 == 0, "scanned").otherwise("native")))
    a = ocr.pages_to_read(d).withColumn("ask", F.lit("read"))
    b = ocr.ambiguous_layout(d).select("doc_id", "page_number", F.lit(None).cast("string").alias("reason"), F.lit("layout").alias("ask"))
    c = vlm_review.pages_to_review(d, most=1).select("doc_id", "page_number", F.lit(None).cast("string").alias("reason"), F.lit("review").alias("ask"))
    return a.unionByName(b).unionByName(c)


_READ = f"""WITH {GRID}, pg AS (SELECT doc_id, page_number, sum(length(content)) AS chars, count(*) AS n, count(*) FILTER (x1 - x0 <= 0.55 * 612 AND (x0 + x1) / 2 < 306) AS l, count(*) FILTER (x1 - x0 <= 0.55 * 612 AND (x0 + x1) / 2 >= 306) AS r FROM el GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN doc_id % 3 = 0 THEN 'scanned' ELSE 'no_text' END AS reason, 'read' AS ask FROM pg WHERE doc_id % 3 = 0 OR chars < 20
UNION ALL SELECT doc_id, page_number, NULL, 'layout' FROM pg WHERE doc_id % 3 <> 0 AND n >= 6 AND l >= 3 AND r >= 3 UNION ALL SELECT doc_id, min(page_number), NULL, 'review' FROM pg WHERE doc_id % 3 = 0 GROUP BY doc_id"""


def line_gaps(spark, sf_dir):
    """L1-L2: the usual length of a line of each document, and the usual gap of its pages."""
    d = grid(spark, sf_dir)
    return line_unwrap.interline_gaps(d).join(line_unwrap.usual_length(d.elements), "doc_id", "left")


_GAPS = f"""WITH {_FS}, g AS (SELECT doc_id, page_number, y0 - lag(y1) OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS gap FROM el), p AS (SELECT doc_id, page_number, median(gap) AS gap FROM g WHERE gap >= 0 GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT el.doc_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM el JOIN fr ON fr.doc_id = el.doc_id AND fr.fname = el.fname AND fr.fsize = el.fsize AND fr.bold = el.bold AND is_body),
u AS (SELECT doc_id, CAST(median(length(t)) AS DOUBLE) AS usual FROM t WHERE length(t) >= 8 AND NOT regexp_matches(t, '^\\s*(?:[*•·●○■□▪▸▹-]|(?:[A-Za-z]|\\d+)[.、)]|[(（](?:[A-Za-z]+|\\d+)[)）]|\\[\\d{{1,6}}\\])') GROUP BY doc_id)
SELECT doc_id, page_number, CAST(gap AS DOUBLE) AS gap, usual FROM p LEFT JOIN u USING (doc_id)"""


def isolated_lines(spark, sf_dir):
    """Lines that stand apart from the last one above them in their column."""
    d = grid(spark, sf_dir)
    return chapter.isolated(d, d.elements.select("doc_id", "page_number", "elem_id", "seq", "bbox")).groupBy("doc_id").agg(F.count("*").alias("n"))


_ISOLATED = f"""WITH {GRID}, p AS (SELECT a.doc_id, a.page_number, a.seq, a.y0, a.y1, arg_max(b.y1, b.seq) AS bottom FROM el a JOIN el b ON b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.seq < a.seq AND b.y1 <= a.y0 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.5 * greatest(a.x1 - a.x0, 1) GROUP BY ALL)
SELECT doc_id, count(*) AS n FROM p WHERE y0 - bottom >= 1.4 * greatest(y1 - y0, 1) GROUP BY doc_id"""


def numbering_coherence(spark, sf_dir):
    """Numbered lines that become headings as their numbers hardly skip any."""
    e = chapter.coherent_numbering(numbered(spark, sf_dir)).elements
    return e.filter("heading_level is not null").groupBy("doc_id", "heading_level").agg(F.count("*").alias("n"))


_COHERENT = f"""WITH {NUMBERED}, w AS (SELECT doc_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM nu),
u AS (SELECT doc_id, replace(t, '*', '') AS t FROM w WHERE length(t) > 1 AND length(t) <= 100 AND NOT regexp_matches(t, '[.;?!。！；？]$') AND NOT regexp_matches(t, '[:：]$') AND NOT regexp_matches(t, '^\\d{{4}}\\s*(?:年|[-/.]\\s*\\d{{1,2}}\\s*[-/.月])') AND NOT regexp_matches(t, '\\.{{3,}}|…{{2,}}') AND NOT regexp_matches(t, '^\\d+$') AND NOT regexp_matches(t, '[>»›]\\s*$')),
r AS (SELECT doc_id, t, CAST(regexp_extract(t, '^(\\d{{1,3}})\\s', 1) AS INTEGER) AS k FROM u WHERE regexp_matches(t, '^\\d{{1,3}}\\s+[A-Za-z一-鿿]')),
s AS (SELECT doc_id, t, CAST(regexp_extract(t, '^(\\d{{1,9}})\\.', 1) AS INTEGER) AS rt, CAST(regexp_extract(t, '^\\d+\\.(\\d{{1,9}})', 1) AS INTEGER) AS k FROM u WHERE regexp_matches(t, '^\\d+(?:\\.\\d+)+(?:[.)、．\\s]|[一-鿿])')),
rg AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT DISTINCT doc_id, k FROM r)), sg AS (SELECT doc_id, rt, k, k - lag(k) OVER (PARTITION BY doc_id, rt ORDER BY k) AS g FROM (SELECT DISTINCT doc_id, rt, k FROM s)),
rok AS (SELECT doc_id FROM rg JOIN (SELECT doc_id, count(*) AS c FROM r GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, c HAVING c BETWEEN 3 AND 8 AND count(*) >= 3 AND coalesce(max(g), 0) <= 2 AND count(*) / (max(k) - min(k) + 1) >= 0.5),
sok AS (SELECT doc_id, rt FROM sg JOIN (SELECT doc_id, rt, count(*) AS c FROM s GROUP BY ALL) USING (doc_id, rt) GROUP BY doc_id, rt, c HAVING c >= 2 AND count(*) >= 2 AND coalesce(max(g), 0) <= 2 AND count(*) / (max(k) - min(k) + 1) >= 0.5)
SELECT doc_id, CAST(lv AS INTEGER) AS heading_level, count(*) AS n FROM (SELECT doc_id, 2 AS lv FROM r SEMI JOIN rok USING (doc_id) WHERE length(t) <= 80 UNION ALL SELECT doc_id, 3 FROM s SEMI JOIN sok USING (doc_id, rt) WHERE length(t) <= 80) GROUP BY ALL"""


def orphan_clusters(spark, sf_dir):
    """C20: headings numbered three deep whose parent isn't there, from line items: order, line and supplier."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_orderkey") % 20).alias("doc_id"), F.lit("text").alias("type"), F.concat(F.when(F.col("l_linenumber") > 5, F.concat(F.lit("3."), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("2."), F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_suppkey").cast("string"))), F.lit(" Title")).alias("content"), F.lit(4).alias("heading_level"))
    return chapter.orphan_clusters(e)


_ORPHANS = """WITH h AS (SELECT l_orderkey % 20 AS doc_id, CASE WHEN l_linenumber > 5 THEN '3.' || l_linenumber ELSE '2.' || l_linenumber || '.' || l_suppkey END AS number FROM lineitem), p AS (SELECT doc_id, 4 AS level, regexp_replace(number, '\\.\\d+$', '') AS prefix, len(string_split(number, '.')) AS depth FROM h)
SELECT doc_id, CAST(level AS INTEGER) AS level, prefix, count(*) AS n FROM p WHERE depth >= 3 AND NOT EXISTS (FROM h WHERE h.doc_id = p.doc_id AND h.number = p.prefix) GROUP BY ALL HAVING count(*) >= 5"""


def image_classes(spark, sf_dir):
    """Parts as images, by size and price."""
    p = table(spark, sf_dir, "part")
    k = image.image_class((F.col("p_size") * 8).cast("double"), (F.col("p_retailprice") / 10).cast("double"), F.when(F.col("p_partkey") % 7 == 0, "table").when(F.col("p_partkey") % 7 == 1, "text"))
    return p.select(k.alias("image_class")).groupBy("image_class").agg(F.count("*").alias("n"))


_CLASS = """WITH s AS (SELECT p_partkey, CAST(p_size * 8 AS DOUBLE) AS w, p_retailprice / 10 AS h FROM part), t AS (SELECT *, least(w, h) AS a, greatest(w, h) AS b FROM s)
SELECT CASE WHEN w * h = 0 THEN 'blank' WHEN a <= 4 OR (a <= 80 AND b / greatest(a, 1) >= 12) OR (w * h <= 12000 AND b <= 160) OR a < 30 THEN 'decorative' WHEN p_partkey % 7 = 0 THEN 'table_image' WHEN p_partkey % 7 = 1 THEN 'text_image' ELSE 'informational' END AS image_class, count(*) AS n FROM t GROUP BY ALL"""


def neighbour_context(spark, sf_dir):
    """The text before and after the lines that rules leave open."""
    d = headed(spark, sf_dir)
    none = d.with_elements(d.elements.withColumn("font", F.lit(None).cast(d.elements.schema["font"].dataType)).withColumn("heading_level", F.lit(None).cast("int")))
    return chapter.fallback_candidates(none).filter("no_signal").select("doc_id", "seq", F.md5("prev_text").alias("prev"), F.md5("next_text").alias("next"))


_CONTEXT = f"""WITH {GRID}, t AS (SELECT doc_id, page_number, seq, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS t FROM el), c AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 79) || '…' END AS s FROM t),
n AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS p, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS q FROM c)
SELECT doc_id, seq, md5(p) AS prev, md5(q) AS "next" FROM n WHERE length(t) BETWEEN 2 AND 30 AND NOT regexp_matches(t, '[.;?!。！；？]$') AND NOT regexp_matches(t, '[:：]$') AND NOT regexp_matches(t, '^[A-Za-z一-鿿]{{1,12}}\\s*[:：]\\s*.') AND NOT regexp_matches(t, '^\\d{{4}}\\s*(?:年|[-/.]\\s*\\d{{1,2}}\\s*[-/.月])') AND NOT regexp_matches(t, '\\.{{3,}}|…{{2,}}') AND NOT regexp_matches(t, '^\\d+$') AND NOT regexp_matches(t, '^[€£¥$₽]\\s*[,\\d]+(?:\\.\\d+)?$') AND NOT regexp_matches(t, '[>»›]\\s*$') AND NOT regexp_matches(t, '(?i)^#{{0,6}}\\s*(?:table|tab\\.|figure|fig\\.|表|图)\\s*\\d')
 AND NOT regexp_matches(t, '^(?:\\d+(?:\\.\\d+)+(?:[.)、．\\s]|[一-鿿])|[(（]?\\d+[)）]|\\d{{1,3}}、[A-Za-z一-鿿]|\\d{{1,3}}\\s+[A-Za-z一-鿿]|\\d+\\.\\s*[A-Za-z一-鿿])')"""


def spacing(spark, sf_dir):
    """Turns rebuilt from their characters, with gaps after every third, in runs and in rows."""
    t = table(spark, sf_dir, "conversations")
    c = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.posexplode(F.split("text", "")).alias("seq", "c")).filter("c <> ''").withColumn("line", F.lit(0)).withColumn("size", F.lit(10.0))
    x = F.col("seq") * 6.0 + F.floor(F.col("seq") / 3) * 4.0
    c = c.withColumn("x0", x).withColumn("x1", x + 6.0)
    return page.spaced_lines(c).select("doc_id", "page_number", F.md5("text").alias("digest"), F.length("text").alias("n"))


_SPACING = r"""WITH c AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_number, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS k FROM conversations WHERE length(text) > 0),
g AS (SELECT *, lag(c) OVER (PARTITION BY doc_id, page_number ORDER BY k) AS p FROM c)
SELECT doc_id, page_number, md5(string_agg((CASE WHEN k > 0 AND k % 3 = 0 AND NOT regexp_matches(c, '^\s') AND NOT regexp_matches(p, '^\s') THEN ' ' ELSE '' END) || c, '' ORDER BY k)) AS digest, CAST(sum(1 + CASE WHEN k > 0 AND k % 3 = 0 AND NOT regexp_matches(c, '^\s') AND NOT regexp_matches(p, '^\s') THEN 1 ELSE 0 END) AS INTEGER) AS n FROM g GROUP BY ALL"""


def format_runs(spark, sf_dir):
    """Runs of words of the same case in every turn."""
    t = table(spark, sf_dir, "conversations")
    w = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.lit(0).alias("block"), F.posexplode(F.split("text", " ")).alias("seq", "c")).withColumn("bold", F.col("c").rlike("^[A-Z]"))
    r = page.format_runs(w, marks=("bold",))
    return r.groupBy("doc_id", "page_number").agg(F.count("*").alias("runs"), F.sum(F.col("bold").cast("long")).alias("bold_runs"), F.max(F.length("text")).alias("longest"))


_FORMAT = """WITH w AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_number, unnest(string_split(text, ' ')) AS c, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations), b AS (SELECT *, regexp_matches(c, '^[A-Z]') AS bold FROM w),
n AS (SELECT *, CASE WHEN bold = lag(bold) OVER (PARTITION BY doc_id, page_number ORDER BY k) THEN 0 ELSE 1 END AS nw FROM b), r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page_number ORDER BY k) AS run FROM n), g AS (SELECT doc_id, page_number, run, bold, sum(length(c)) AS n FROM r GROUP BY ALL)
SELECT doc_id, page_number, count(*) AS runs, CAST(sum(CAST(bold AS INTEGER)) AS BIGINT) AS bold_runs, CAST(max(n) AS INTEGER) AS longest FROM g GROUP BY ALL"""


def page_gaps(spark, sf_dir):
    """Pages filled in between those that events have, by user and type."""
    p = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("doc_id"), (F.col("event_id") % 37 + 1).cast("int").alias("page_number")).distinct()
    full = page.fill_pages(complete(p.withColumn("width", F.lit(600.0)), PAGE))
    return full.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("width").alias("given"))


_FILL = "WITH p AS (SELECT DISTINCT user_id % 50 AS doc_id, event_id % 37 + 1 AS n FROM events) SELECT doc_id, CAST(max(n) AS BIGINT) AS pages, count(*) AS given FROM p GROUP BY doc_id"

LAYOUT = {
    "font_mode": (font_mode, _FONTS), "heading_fonts": (heading_fonts, _HEADING_FONTS), "repeated_edges": (repeated_edges, _REPEATED), "header_footer_removal": (header_footer_removal, _REMOVAL),
    "mixed_mono": (mixed_mono, _MONO), "code_runs": (code_runs, _RUNS), "gutters": (gutters, _GUTTERS), "page_layouts": (page_layouts, _LAYOUTS), "reading_orders": (reading_orders, _ORDER),
    "body_band": (body_band, "WITH " + _BAND), "repeated_assets": (repeated_assets, _ASSETS), "table_antijoin": (table_antijoin, "WITH " + _ANTI), "figure_containment": (figure_containment, "WITH " + _CONTAIN), "nearest_figure": (nearest_figure, "WITH " + _NEAREST),
    "image_evidence": (image_evidence, "WITH " + _EVIDENCE), "region_assignment": (region_assignment, "WITH " + _REGION), "page_classes": (page_classes, "WITH " + _CLASSES), "pages_to_read": (pages_to_read, _READ), "line_gaps": (line_gaps, _GAPS),
    "isolated_lines": (isolated_lines, _ISOLATED), "numbering_coherence": (numbering_coherence, _COHERENT), "orphan_clusters": (orphan_clusters, _ORPHANS), "image_classes": (image_classes, _CLASS), "neighbour_context": (neighbour_context, _CONTEXT),
    "spacing": (spacing, _SPACING), "format_runs": (format_runs, _FORMAT), "page_gaps": (page_gaps, _FILL),
}
