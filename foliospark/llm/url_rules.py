"""URL filters by association rules.

A URL becomes a set of tokens: scheme, labels of the host and the parts of hyphenated ones, registered name, path segments
with digits as ``#``, file suffix, query keys, and whether there is a fragment. FP-growth mines the token sets of labelled URLs
together with an item for the label ``bad``; an itemset with that item gives the rule "tokens -> bad". Rules below the least support, confidence or lift
go, and so does a rule if some of its tokens alone are as sure a rule. The rest match by an inverted index: each token
lists its rules, and a rule applies if as many of a URL's tokens list it as it has.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import materialise

#: A rule's tokens and the label must occur together in this share of the labelled URLs, and in so many of them at least.
MIN_SUPPORT, MIN_COUNT = 0.0005, 8
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.2
BAD = "label=bad"
#: As many rules are broadcast; more are joined.
BROADCAST_RULES = 100_000


def url_tokens(url):
    """The set of tokens of a URL column, as a sorted array; empty for null and empty URLs. Case of scheme and host doesn't matter."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    after = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(after, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$", ""))
    rest = F.regexp_replace(after, r"^[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda v: F.instr(v, "-") > 0), lambda v: F.split(v, "-")))
    segments = F.transform(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda s: F.regexp_replace(F.lower(s), r"\d+", "#"))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]{0,4})$", 1))
    keys = F.transform(F.split(query, "&"), lambda s: F.regexp_extract(s, r"^([^=]*)", 1))

    def named(name, values):
        return F.transform(F.filter(values, lambda v: F.length(v) > 0), lambda v: F.concat(F.lit(name + "="), v))

    one = lambda name, value: named(name, F.array(value))
    site = F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host)
    tail = F.when(F.length(path) > 1, F.when(path.endswith("/"), F.lit("slash")).otherwise(F.lit(""))).otherwise(F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(one("scheme", scheme), named("host", labels), named("word", words), one("site", site), named("path", segments), one("suffix", suffix), one("end", tail), named("key", keys), F.when(F.instr(u, "#") > 0, F.array(F.lit("fragment=yes"))).otherwise(F.array().cast("array<string>")))))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(rule, tokens, support, confidence, lift) of the rules that labelled (tokens, bad) gives; rule is its tokens in one string.

    Nothing comes of an empty table. A rule goes if a rule of some of its tokens is at least as confident.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule string, tokens array<string>, support double, confidence double, lift double")
    counts = labelled.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    n, bad = counts.n, counts.bad or 0
    least = max(min_count, min_support * n)
    if not n or bad < least:
        return empty
    items = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    # A hair below, so that rounding doesn't lose sets that occur exactly so often.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n - 1e-12), minConfidence=min_confidence).fit(items)
    # Both sides of a rule's confidence are frequent sets: the tokens with the label, and the tokens alone.
    sets = materialise(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = sets.filter(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("hits"))
    rules = with_bad.filter(F.size("tokens") > 0).join(sets.filter(~F.array_contains("items", BAD)).withColumnRenamed("items", "tokens"), "tokens")
    rules = rules.select("tokens", (F.col("hits") / F.lit(n)).alias("support"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.col("freq") / F.lit(bad / n)).alias("lift")).filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    rules = materialise(rules, "rules")
    # A smaller rule shares the larger one's every token, so its first token finds it.
    small = rules.select(F.col("tokens").alias("some"), F.element_at("tokens", 1).alias("key"), F.col("confidence").alias("sure"))
    large = rules.select("tokens", "confidence", F.explode("tokens").alias("key"))
    weaker = large.join(small, "key").filter((F.size("some") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("some", "tokens")) == 0)).select("tokens").distinct()
    return materialise(rules.join(weaker, "tokens", "left_anti").select(F.array_join("tokens", " ").alias("rule"), "tokens", "support", "confidence", "lift"), "kept-rules")


def _index(rules: list) -> tuple[dict[str, list[int]], list[int], list[str], list[float]]:
    """For each token the places of its rules; and their sizes, names and confidences, in order of the names."""
    rules = sorted(rules, key=lambda r: r.rule)
    by_token: dict[str, list[int]] = defaultdict(list)
    for k, r in enumerate(rules):
        for t in r.tokens:
            by_token[t].append(k)
    return dict(by_token), [len(r.tokens) for r in rules], [r.rule for r in rules], [r.confidence for r in rules]


def match_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, url, n_rules, rules, confidence, blocked): the rules that apply to each row, and the greatest confidence among them."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    schema = "page_id long, url string, n_rules int, rules string, confidence double, blocked boolean"
    if rules.count() <= broadcast_rules:
        held = pages.sparkSession.sparkContext.broadcast(_index(rules.select("rule", "tokens", "confidence").collect()))

        def run(batches):
            by_token, sizes, names, sure = held.value
            for batch in batches:
                hits = []
                for tokens in batch.column(2).to_pylist():
                    seen: dict[int, int] = {}
                    for t in tokens:
                        for r in by_token.get(t, ()):
                            seen[r] = seen.get(r, 0) + 1
                    hits.append(sorted(r for r, k in seen.items() if k == sizes[r]))
                text = pa.array(["; ".join(names[r] for r in h) or None for h in hits], pa.string())
                best = pa.array([max((sure[r] for r in h), default=None) for h in hits], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in hits], pa.int32()), text, best, pa.array([bool(h) for h in hits])], ["page_id", "url", "n_rules", "rules", "confidence", "blocked"])

        return rows.withColumn("tokens", url_tokens(F.col("url"))).mapInArrow(run, schema)
    # The index as a table: URLs meet their rules through tokens.
    index = rules.select("rule", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    urls = rows.select("url").filter("url is not null").distinct()
    hits = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token").groupBy("url", "rule").agg(F.count("*").alias("k"), F.first("size").alias("size"), F.first("confidence").alias("c")).filter("k = size")
    found = hits.groupBy("url").agg(F.count("*").cast("int").alias("n_rules"), F.array_join(F.array_sort(F.collect_list("rule")), "; ").alias("rules"), F.max("c").alias("confidence"))
    return rows.join(found, "url", "left").select("page_id", "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "rules", "confidence", F.col("n_rules").isNotNull().alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", **bounds) -> DataFrame:
    """(page_id, url, n_rules, rules, confidence, blocked) for each row of pages, by rules mined from its labelled rows.

    A row is labelled if labels has its id; it is bad if some label of that id says quality 0 or toxic 1. Null ids are
    not labelled. Null and empty URLs have no tokens, so no rule applies. Rows that repeat count and are matched each. An empty
    table, or one without bad labels, blocks nothing; other columns are ignored.
    """
    marks = labels.filter(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1, F.lit(False))).alias("bad"))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    labelled = named.join(marks, "page_id").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    rules = mine_rules(materialise(labelled, "labelled-urls"), **bounds)
    return match_rules(pages, rules, id_col, url_col)
