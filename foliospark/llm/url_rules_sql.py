"""The SQL of the URL filter: token sets, all subsets of them, supports, and what the rules match."""

from foliospark.llm.url_rules import MIN_CONFIDENCE, MIN_COUNT, MIN_LIFT, MIN_SUPPORT

URL_FILTER = rf"""WITH RECURSIVE u AS (SELECT page_id, url, coalesce(url, '') AS x, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS a FROM pages),
v AS (SELECT *, lower(regexp_replace(regexp_extract(a, '^([^/?#]*)', 1), '^[^@]*@|:\d*$', '', 'g')) AS h, regexp_extract(regexp_replace(a, '^[^/?#]*', ''), '^([^?#]*)', 1) AS p, regexp_extract(regexp_replace(a, '^[^/?#]*', ''), '^[^?#]*\?([^#]*)', 1) AS q FROM u),
w AS (SELECT page_id, url, list_sort(list_distinct(list_concat(
  CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ['scheme=' || lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))] ELSE [] END,
  list_transform(list_filter(string_split(h, '.'), lambda s: s <> ''), lambda s: 'host=' || s),
  list_transform(list_filter(flatten(list_transform(list_filter(string_split(h, '.'), lambda s: contains(s, '-')), lambda s: string_split(s, '-'))), lambda s: s <> ''), lambda s: 'word=' || s),
  CASE WHEN h = '' THEN [] WHEN len(string_split(h, '.')) >= 2 THEN ['site=' || array_to_string(string_split(h, '.')[-2:], '.')] ELSE ['site=' || h] END,
  list_transform(list_filter(list_transform(string_split(regexp_replace(p, '\.[A-Za-z0-9]{{1,5}}$', ''), '/'), lambda s: regexp_replace(lower(s), '\d+', '#', 'g')), lambda s: s <> ''), lambda s: 'path=' || s),
  CASE WHEN regexp_matches(p, '\.([A-Za-z][A-Za-z0-9]{{0,4}})$') THEN ['suffix=' || lower(regexp_extract(p, '\.([A-Za-z][A-Za-z0-9]{{0,4}})$', 1))] ELSE [] END,
  CASE WHEN length(p) > 1 AND ends_with(p, '/') THEN ['end=slash'] ELSE [] END,
  list_transform(list_filter(list_transform(string_split(q, '&'), lambda s: regexp_extract(s, '^([^=]*)', 1)), lambda s: s <> ''), lambda s: 'key=' || s),
  CASE WHEN contains(x, '#') THEN ['fragment=yes'] ELSE [] END))) AS t FROM v),
m AS (SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, FALSE) OR coalesce(toxic = 1, FALSE)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
lb AS (SELECT row_number() OVER () AS id, t, bad FROM w JOIN m USING (page_id)),
tot AS (SELECT count(*) AS n, count(*) FILTER (bad) AS b, greatest({MIN_COUNT}, {MIN_SUPPORT} * count(*)) AS least FROM lb),
sub AS (SELECT id, bad, t, 0 AS last, CAST([] AS VARCHAR[]) AS s FROM lb UNION ALL SELECT id, bad, t, k, list_append(s, t[k]) FROM sub, range(1, 40) r(k) WHERE k > last AND k <= len(t)),
st AS (SELECT s, count(*) AS f, count(*) FILTER (bad) AS hit FROM sub WHERE len(s) > 0 GROUP BY s),
ru AS (SELECT s, hit / f AS c FROM st, tot WHERE hit >= least AND hit / f >= {MIN_CONFIDENCE} AND hit / f / (b / n) >= {MIN_LIFT}),
kp AS (SELECT * FROM ru WHERE NOT EXISTS (SELECT 1 FROM ru o WHERE len(o.s) < len(ru.s) AND o.c >= ru.c AND list_has_all(ru.s, o.s))),
ht AS (SELECT w.page_id, w.url, count(*) AS n, string_agg(array_to_string(s, ' '), '; ' ORDER BY array_to_string(s, ' ')) AS r, max(c) AS c FROM w JOIN kp ON list_has_all(w.t, kp.s) GROUP BY ALL)
SELECT w.page_id, w.url, CAST(coalesce(ht.n, 0) AS INTEGER) AS n_rules, ht.r AS rules, ht.c AS confidence, ht.n IS NOT NULL AS blocked FROM w LEFT JOIN ht ON ht.page_id = w.page_id"""
