"""Text functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import headings as H
from foliospark.functions import tables as T
from foliospark.functions import text as X
from foliospark.operators.formula import correction_score
from foliospark.operators.image import is_chinese, number_mismatch
from foliospark.operators.ocr import char_overlap, looks_like_title
from foliospark.queries.base import GRID, NUMBERED, grid, numbered, table
from foliospark.sources.files import subset_top_n
from foliospark.sources.text import line_elements


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_clean(spark, sf_dir):
    """The cleaned text of every document, by its length and digest."""
    c = X.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


_CLEAN = f"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(translate(translate(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
 {_sql("".join(X._C1))}, {_sql("".join(X._C1.values()))}), {_sql("".join(X._WIDE))}, {_sql("".join(X._WIDE.values()))}), '^{{^{{\\prime}}}}', ''''), '^{{\\prime}}', ''''), '[^\\S\\n]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM documents)"""


def cjk_gaps(spark, sf_dir):
    """Documents with ideographs for their vowels and Chinese marks for theirs, without the blanks between these."""
    c = X.close_cjk_gaps(F.translate("text", "aeiou.,", "中文字表格。，"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


def _gaps(c: str, passes: int = 3) -> str:
    """Each kind of gap closed again and again, since a pattern takes the characters at both sides."""
    for _ in range(passes):
        for left, right in ((X.CJK_WIDE, X.CJK_WIDE), (X.CJK_WIDE, X.CJK_MARKS), (X.CJK_MARKS, X.CJK_WIDE)):
            c = f"regexp_replace({c}, '([{left}])[^\\S\\n]+([{right}])', '\\1\\2', 'g')"
    return c


_CJK = f"SELECT doc_id, CAST(length(c) AS INTEGER) AS n, md5(c) AS digest FROM (SELECT doc_id, {_gaps("translate(text, 'aeiou.,', '中文字表格。，')")} AS c FROM documents)"


def line_split_counts(spark, sf_dir):
    """Lines and pages of every document."""
    return line_elements(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("page_number").cast("long").alias("pages"), F.max(F.length("content")).cast("long").alias("longest"))


_LINES = f"WITH {GRID} SELECT doc_id, count(*) AS lines, CAST(max(page_number) AS BIGINT) AS pages, CAST(max(length(content)) AS BIGINT) AS longest FROM el GROUP BY doc_id"


def comparison_form(spark, sf_dir):
    """What of every turn is compared."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.for_comparison(F.col("text"))).alias("digest"), F.length(X.compact(F.col("text"))).alias("compact_chars"), X.line_count(F.col("text")).alias("lines"))


_COMPARISON = r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+', '', 'g'), '<!-- PAGE \d+ -->', '', 'g'), '\s+', ' ', 'g'))) AS digest,
 CAST(length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')) AS INTEGER) AS compact_chars,
 CAST(greatest(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 1) AS INTEGER) AS lines FROM conversations"""


def heading_predicates(spark, sf_dir):
    """How many lines of each language each predicate takes."""
    e = line_elements(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    c = F.col("content")
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    return e.groupBy("lang").agg(n(H.is_not_heading(c)).alias("not_heading"), n(H.is_metadata(c)).alias("metadata"), n(H.is_body(c)).alias("body"), n(H.is_short(c)).alias("short"), n(H.ends_with_colon(c)).alias("colon"), n(H.is_page_number(c)).alias("page_number"), n(H.is_list_item(c)).alias("list_item"), n(H.is_toc_header(c)).alias("toc_header"))


_CN = "一二三四五六七八九十百千万"
_PREDICATES = rf"""WITH {GRID}, s AS (SELECT lang, content, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM el JOIN documents USING (doc_id))
SELECT lang, CAST(sum(CASE WHEN regexp_matches(t, '^\d{{4}}\s*(?:年|[-/.]\s*\d{{1,2}}\s*[-/.月])') OR regexp_matches(t, '\.{{3,}}|…{{2,}}') OR regexp_matches(t, '^\d+$') OR regexp_matches(t, '^[€£¥$₽]\s*[,\d]+(?:\.\d+)?$') OR regexp_matches(t, '[>»›]\s*$') OR regexp_matches(t, '(?i)^#{{0,6}}\s*(?:table|tab\.|figure|fig\.|表|图)\s*\d') OR length(t) <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS not_heading,
 CAST(sum(CASE WHEN regexp_matches(t, '^[A-Za-z一-鿿]{{1,12}}\s*[:：]\s*.') OR regexp_matches(t, '^\d{{4}}\s*(?:年|[-/.]\s*\d{{1,2}}\s*[-/.月])') THEN 1 ELSE 0 END) AS BIGINT) AS metadata,
 CAST(sum(CASE WHEN length(t) > 100 OR regexp_matches(t, '[.;?!。！；？]$') THEN 1 ELSE 0 END) AS BIGINT) AS body, CAST(sum(CASE WHEN length(t) <= 80 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN regexp_matches(t, '[:：]$') THEN 1 ELSE 0 END) AS BIGINT) AS colon,
 CAST(sum(CASE WHEN regexp_matches(t, '^[—\s-]*\d{{1,5}}[—\s-]*$') OR regexp_matches(t, '(?i)^[—\s-]*[cdilmvx]+[—\s-]*$') OR regexp_matches(t, '^[-–—]\s*\d+\s*[-–—]$') OR regexp_matches(t, '^第\s*\d+\s*页$') THEN 1 ELSE 0 END) AS BIGINT) AS page_number,
 CAST(sum(CASE WHEN regexp_matches(content, '^\s*(?:[*•·●○■□▪▸▹-]|(?:[A-Za-z]|\d+)[.、)]|[{_CN}]+[.、]|第[0-9{_CN}]+[章节编条款项目]|[(（](?:[A-Za-z{_CN}]+|\d+)[)）]|\[\d{{1,6}}\])') THEN 1 ELSE 0 END) AS BIGINT) AS list_item,
 CAST(sum(CASE WHEN lower(t) IN ('contents', 'table of content', 'table of contents', '目录', '目 录') THEN 1 ELSE 0 END) AS BIGINT) AS toc_header FROM s GROUP BY lang"""


def numbering_histogram(spark, sf_dir):
    """Numbering of numbered lines."""
    e = numbered(spark, sf_dir).elements
    h = e.select("doc_id", H.numbering_signal(X.first_line(F.col("content"))).alias("signal"), H.numbering_level(X.first_line(F.col("content"))).alias("level"))
    return h.filter("signal is not null").groupBy("doc_id", "signal", "level").agg(F.count("*").alias("n"))


_SIGNAL = r"""CASE WHEN regexp_matches(t, '^\d+(?:\.\d+)+(?:[.)、．\s]|[一-鿿])') THEN 'section_arabic_nested' WHEN regexp_matches(t, '^[(（]?\d+[)）]') THEN 'section_arabic_paren' WHEN regexp_matches(t, '^\d{1,3}、[A-Za-z一-鿿]') THEN 'section_arabic_ideograph' WHEN regexp_matches(t, '^\d{1,3}\s+[A-Za-z一-鿿]') THEN 'section_arabic_spaced' WHEN regexp_matches(t, '^\d+\.\s*[A-Za-z一-鿿]') THEN 'section_arabic_root' END"""
_HISTOGRAM = f"""WITH {NUMBERED}, s AS (SELECT doc_id, replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '*', '') AS t FROM nu), g AS (SELECT doc_id, t, {_SIGNAL} AS signal FROM s)
SELECT doc_id, signal, CAST(CASE signal WHEN 'section_arabic_nested' THEN least(len(string_split(regexp_extract(t, '^(\\d+(?:\\.\\d+)+)', 1), '.')) + 1, 6) WHEN 'section_arabic_paren' THEN 3 ELSE 2 END AS INTEGER) AS level, count(*) AS n FROM g WHERE signal IS NOT NULL GROUP BY ALL"""


def captions_kinds(spark, sf_dir):
    """Lines that read like captions once a label is put before every seventh."""
    e = line_elements(table(spark, sf_dir, "documents"))
    k = F.col("seq").cast("long") % 7
    c = F.when(k == 0, F.concat(F.lit("Figure "), F.col("seq").cast("long").cast("string"), F.lit(": "), F.col("content"))).when(k == 1, F.concat(F.lit("Table: "), F.col("content"))).otherwise(F.col("content"))
    return e.withColumn("kind", H.caption_kind(c)).groupBy("doc_id").agg(F.sum((F.col("kind") == "figure").cast("long")).alias("figures"), F.sum((F.col("kind") == "table").cast("long")).alias("tables"))


_CAPTIONS = rf"""WITH {GRID}, c AS (SELECT doc_id, CASE CAST(seq AS BIGINT) % 7 WHEN 0 THEN 'Figure ' || CAST(seq AS BIGINT) || ': ' || content WHEN 1 THEN 'Table: ' || content ELSE content END AS t FROM el),
k AS (SELECT doc_id, CASE WHEN length(t) > 160 THEN NULL WHEN regexp_matches(t, '(?i)^\s*(?:figure|fig\.?|图表|图)\s*[A-Za-z0-9零〇一二三四五六七八九十百千万两().\-]+\s*(?:[:：.\-]\s*|\s+)\S.*$') OR length(regexp_replace(regexp_extract(t, '(?is)^\s*(?:figure|fig\.?|图表|图)\s*[:：.\-]\s*(.+)$', 1), '^\s+|\s+$', '', 'g')) BETWEEN 2 AND 60 THEN 'figure'
 WHEN regexp_matches(t, '(?i)^\s*(?:table|表)\s*[A-Za-z0-9零〇一二三四五六七八九十百千万两().\-]+\s*(?:[:：.\-]\s*|\s+)\S.*$') OR length(regexp_replace(regexp_extract(t, '(?is)^\s*(?:table|表)\s*[:：.\-]\s*(.+)$', 1), '^\s+|\s+$', '', 'g')) BETWEEN 2 AND 60 THEN 'table' END AS kind FROM c)
SELECT doc_id, CAST(sum(CAST(kind = 'figure' AS BIGINT)) AS BIGINT) AS figures, CAST(sum(CAST(kind = 'table' AS BIGINT)) AS BIGINT) AS tables FROM k GROUP BY doc_id"""


def char_multiset_overlap(spark, sf_dir):
    """How much of a benchmark passage's characters each document has; the passages take turns."""
    passages = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % passages.count()).alias("item_id"), X.without_space(F.col("text")).alias("d"))
    b = passages.select("item_id", X.without_space(F.col("text")).alias("b"))
    return d.join(b, "item_id").select("doc_id", F.round(char_overlap(F.col("b"), F.col("d")), 6).alias("overlap"))


_OVERLAP = r"""WITH b AS (SELECT doc_id, regexp_replace(b.text, '\s+', '', 'g') AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents),
bc AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM b) GROUP BY ALL), dc AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM d) GROUP BY ALL)
SELECT doc_id, round(sum(least(bc.n, coalesce(dc.n, 0))) / sum(bc.n), 6) AS overlap FROM bc JOIN d USING (doc_id) LEFT JOIN dc USING (doc_id, c) GROUP BY doc_id"""


def language_vote(spark, sf_dir):
    """I4: ideographs and numbers of every document against its neighbour's; the last one has none."""
    d = table(spark, sf_dir, "documents")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(n, "doc_id", "left").select("doc_id", is_chinese(F.col("text")).alias("chinese"), F.size(X.numbers(F.col("text"))).alias("numbers"), F.coalesce(number_mismatch(F.col("text"), F.col("other")), F.lit(False)).alias("mismatch"))


_VOTE = r"""SELECT d.doc_id, len(regexp_extract_all(d.text, '[㐀-䶿一-鿿豈-﫿]')) >= greatest(12, 2 * len(regexp_extract_all(d.text, '[A-Za-z]'))) AS chinese, CAST(len(regexp_extract_all(d.text, '\d+(?:\.\d+)?')) AS INTEGER) AS numbers,
 coalesce(len(regexp_extract_all(d.text, '\d+(?:\.\d+)?')) > 0 AND len(regexp_extract_all(o.text, '\d+(?:\.\d+)?')) > 0 AND regexp_extract_all(d.text, '\d+(?:\.\d+)?') <> regexp_extract_all(o.text, '\d+(?:\.\d+)?'), FALSE) AS mismatch FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1"""


def warning_summary(spark, sf_dir):
    """Warnings that events stand for, by category."""
    from foliospark.evaluate.runs import summarize_warnings

    k = F.col("event_id") % 4
    w = F.when(k == 0, F.concat(F.lit("Page 1: Number mismatch in "), "event_type")).when(k == 1, F.concat(F.lit("Page 2: heading level jump from H1 to H"), F.col("user_id").cast("string"))).when(k == 2, F.lit("Table count mismatch: 1, 2")).otherwise(F.col("event_type"))
    return summarize_warnings(table(spark, sf_dir, "events").select(w.alias("warning")))


_WARNING = """SELECT code, label, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'number_mismatch' WHEN 1 THEN 'heading_level_jump' WHEN 2 THEN 'table_count_mismatch' ELSE 'other' END AS code, CASE event_id % 4 WHEN 0 THEN 'Number mismatch' WHEN 1 THEN 'Heading level jump' WHEN 2 THEN 'Table count mismatch' ELSE 'Other' END AS label FROM events) GROUP BY ALL"""


def pipe_tables(spark, sf_dir):
    """Shape of the tables that lines in pipes make, by document."""
    d = grid(spark, sf_dir).elements.filter(F.instr("content", "|") > 0)
    t = d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: F.concat(F.lit("|"), F.regexp_replace(x.content, r"^\|+|\|+\z", ""), F.lit("|"))), "\n").alias("md"))
    p = T.parse_table(F.col("md"))
    return t.select("doc_id", F.size(p.header).alias("columns"), F.size(p.rows).alias("rows"), T.column_count(F.col("md")).alias("counted"), T.is_degenerate(F.col("md")).alias("degenerate"), F.md5(T.build_table(p.header, p.separator, p.rows)).alias("digest"))


_PIPES = rf"""WITH {GRID}, p AS (SELECT doc_id, seq, regexp_replace(content, '^\|+|\|+$', '', 'g') AS c FROM el WHERE contains(content, '|')),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, list_transform(string_split(c, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM p),
h AS (SELECT doc_id, cells AS head FROM r WHERE k = 1), m AS (SELECT doc_id, count(*) AS k FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN m.k >= 2 THEN CAST(len(head) AS INTEGER) END AS columns, CASE WHEN m.k >= 2 THEN CAST(m.k - 1 AS INTEGER) END AS rows, CAST(len(head) AS INTEGER) AS counted, FALSE AS degenerate,
 CASE WHEN m.k >= 2 THEN (SELECT md5('| ' || array_to_string(h.head, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(h.head, lambda x: '---'), '|') || '|' || chr(10) || string_agg('| ' || array_to_string(list_resize(r.cells, len(h.head), ''), ' | ') || ' |', chr(10) ORDER BY r.k)) FROM r WHERE r.doc_id = h.doc_id AND r.k > 1) END AS digest
FROM h JOIN m USING (doc_id)"""


def subset_topn(spark, sf_dir):
    """The longest documents of each of three specifications, none taken twice."""
    specs = [{"name": "english", "where": "lang = 'en'", "limit": 20}, {"name": "src0", "where": "source = 'src0'", "limit": 20}, {"name": "any", "where": "n_chars >= 100", "limit": 30}]
    return subset_top_n(table(spark, sf_dir, "documents"), specs)


_SUBSET = """WITH a AS (SELECT 'english' AS spec, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 20),
b AS (SELECT 'src0' AS spec, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source = 'src0' AND doc_id NOT IN (SELECT doc_id FROM a) QUALIFY rank <= 20),
c AS (SELECT 'any' AS spec, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars >= 100 AND doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) QUALIFY rank <= 30)
SELECT spec, doc_id, CAST(rank AS INTEGER) AS rank FROM (FROM a UNION ALL FROM b UNION ALL FROM c)"""


def json_properties(spark, sf_dir):
    """events' properties out of text around them."""
    from foliospark.sources.files import parse_json_column

    raw = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    p = parse_json_column(raw, "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.size(p).alias("n"), F.array_join(F.array_sort(F.map_keys(p)), ",").alias("keys"))


_JSON = "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events"


def title_shapes(spark, sf_dir):
    """Lines that may be titles, and lines that look like broken notation."""
    e = line_elements(table(spark, sf_dir, "documents"))
    return e.groupBy("doc_id").agg(F.sum(looks_like_title(F.col("content"), F.lit("paragraph_title")).cast("long")).alias("titles"), F.sum(correction_score(F.col("content"))).cast("long").alias("score"))


_TITLES = rf"""WITH {GRID}, s AS (SELECT doc_id, content, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t, regexp_replace(content, '\s+', '', 'g') AS p FROM el)
SELECT doc_id, CAST(sum(CAST(length(t) BETWEEN 1 AND 120 AND NOT regexp_matches(t, '[.;?!。！；？]$') AND NOT (length(p) >= 24 AND NOT contains(t, ' ') AND regexp_matches(p, '[0-9]') AND length(regexp_replace(p, '[^,\-\[\]()]', '', 'g')) >= 6 AND regexp_matches(p, '^[A-Za-z0-9,\-\[\]()]+$')) AS INTEGER)) AS BIGINT) AS titles,
 CAST(sum(CAST(regexp_matches(content, '[₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ℃°μ≥≤≫≪±×÷≠≈]|\$ (?:\{{\}}|_)') AS INTEGER) + CAST(regexp_matches(content, '\\[A-Za-z]+|\^\{{[^{{}}]{{1,20}}\}}|_\{{[^{{}}]{{1,20}}\}}') AS INTEGER) + CAST(regexp_matches(content, '\$[^$\n]{{1,120}}\$') AS INTEGER) + CAST(regexp_matches(content, '\b[A-Za-z]{{1,3}}\d+[A-Za-z0-9+-]*\b') AS INTEGER) + CAST(regexp_matches(content, '\b[A-Za-z0-9]{{1,20}}[_^=+/-][A-Za-z0-9{{}}()+/-]{{1,30}}\b') AS INTEGER)) AS BIGINT) AS score FROM s GROUP BY doc_id"""

TEXTS = {
    "text_clean": (text_clean, _CLEAN),
    "cjk_gaps": (cjk_gaps, _CJK),
    "line_split_counts": (line_split_counts, _LINES),
    "comparison_form": (comparison_form, _COMPARISON),
    "heading_predicates": (heading_predicates, _PREDICATES),
    "numbering_histogram": (numbering_histogram, _HISTOGRAM),
    "caption_kinds": (captions_kinds, _CAPTIONS),
    "char_multiset_overlap": (char_multiset_overlap, _OVERLAP),
    "language_vote": (language_vote, _VOTE),
    "warning_summary": (warning_summary, _WARNING),
    "pipe_tables": (pipe_tables, _PIPES),
    "subset_topn": (subset_topn, _SUBSET),
    "json_properties": (json_properties, _JSON),
    "title_shapes": (title_shapes, _TITLES),
}
