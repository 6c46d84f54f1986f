"""Cleaning the text of elements, and of their spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.text import clean, py_strip
from foliospark.model import DocSet


def clean_elements(d: DocSet, encoding: bool = True, fullwidth: bool = True, cjk_spaces: bool = True) -> DocSet:
    """Texts, headers and footers cleaned. Spans are cleaned each, keeping blanks between them; the first and last lose theirs at the ends, and the content is what they say."""
    args = (encoding, fullwidth, cjk_spaces)
    some = F.filter(F.transform("spans", lambda s: F.struct(clean(s.text, *args, strip=False).alias("text"), s.bold.alias("bold"), s.italic.alias("italic"), s.underline.alias("underline"), s.sup.alias("sup"))), lambda s: F.length(s.text) > 0)
    blank = lambda s: F.length(py_strip(s.text)) == 0
    solid = F.filter(F.transform(some, lambda s, i: F.struct(i.alias("i"), blank(s).alias("blank"))), lambda x: ~x.blank)
    first, last = F.get(solid, F.lit(0)).i, F.element_at(solid, -1).i
    edge = lambda s, i: F.regexp_replace(F.when(i == first, F.regexp_replace(s.text, r"(?U)^\s+", "")).otherwise(s.text), F.lit(r"(?U)\s+\z"), F.lit(""))
    kept = F.when(F.size(solid) > 0, F.transform(F.slice(some, first + 1, last - first + 1), lambda s, i: F.struct(F.when(i == last - first, edge(s, i + first)).when(i == 0, F.regexp_replace(s.text, r"(?U)^\s+", "")).otherwise(s.text).alias("text"), s.bold.alias("bold"), s.italic.alias("italic"), s.underline.alias("underline"), s.sup.alias("sup"))))
    ours = F.col("type").isin("text", "header", "footer")
    spanned = ours & (F.size("spans") > 0)
    e = d.elements.withColumn("__spans", F.when(spanned, kept))
    said = F.array_join(F.transform("__spans", lambda s: s.text), "")
    e = e.withColumn("content", F.when(spanned, F.coalesce(said, F.lit(""))).when(ours, clean(F.col("content"), *args)).otherwise(F.col("content")))
    e = e.withColumn("spans", F.when(spanned, F.col("__spans")).otherwise(F.col("spans")))
    return d.with_elements(e.select(*d.elements.columns))
