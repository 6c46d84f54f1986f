"""The data model: documents, pages and elements as three tables.

An element is a row. Its place in the document is ``(page_number, seq)``; ``elem_id`` names it across stages. What
decides anything later is a typed column; ``extra`` holds the rest. A missing box is null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
FONT = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType())])
SPAN = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "underline", "sup"))])

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
#: All columns of elements; those but the first five may be missing until :func:`complete` adds them as null.
ELEMENT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("doc_id", T.LongType()), ("page_number", _I), ("seq", _D), ("type", _S), ("content", _S),
            ("elem_id", _S), ("bbox", BBOX), ("font", FONT), ("confidence", _D), ("source", _S), ("layout_type", _S), ("spans", T.ArrayType(SPAN)),
            ("heading_level", _I), ("skip_render", _B), ("skip_reason", _S), ("code_block", _B), ("underline", _B), ("inline", _B),
            ("column", _S), ("column_right", _D), ("retained_identity", _B), ("section_header", _B), ("toc_header", _B), ("toc_entry", _B),
            ("level_hint", _I), ("heading_reason", _S), ("merged_from", T.ArrayType(_I)), ("rows", _I),
            ("width", _D), ("height", _D), ("xref", T.LongType()), ("saved_path", _S), ("image_class", _S), ("needs_vlm", _B), ("vector_figure", _B), ("embedded_image", _B),
            ("description", _S), ("description_source", _S), ("text_heavy", _B), ("evidence_text", _S), ("evidence_table", _S), ("vlm_type", _S), ("vlm_summary", _S), ("corrected_text", _S), ("corrected_table", _S), ("skipped", _B),
            ("caption", _S), ("caption_kind", _S), ("ocr_caption", _S), ("value_score", _D), ("value_reason", _S),
            ("extra", T.MapType(_S, _S)),
        )
    ]
)
PAGE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page_number", _I), T.StructField("width", _D), T.StructField("height", _D), T.StructField("page_type", _S), T.StructField("drawing_count", _I), T.StructField("curve_count", _I)])
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source_path", _S), T.StructField("source_format", _S), T.StructField("title", _S), T.StructField("page_count", _I)])


@dataclass(frozen=True)
class DocSet:
    """Any number of documents. Stages take one and return another."""

    docs: DataFrame
    pages: DataFrame
    elements: DataFrame

    def with_elements(self, elements: DataFrame) -> DocSet:
        return replace(self, elements=elements)

    def with_pages(self, pages: DataFrame) -> DocSet:
        return replace(self, pages=pages)


def complete(df: DataFrame, schema: T.StructType = ELEMENT) -> DataFrame:
    """df with just the columns of schema, in its order and types; missing ones are null, but an elem_id is made of the place."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name == "elem_id":
            made = F.concat_ws(":", "doc_id", "page_number", "seq")
            out.append((F.coalesce(F.col("elem_id").cast("string"), made) if "elem_id" in have else made).alias("elem_id"))
        elif f.name in have:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def flag(name: str):
    """A boolean column with null as false."""
    return F.coalesce(F.col(name), F.lit(False))


def is_text():
    return F.col("type") == "text"


PLACE = ("page_number", "seq")
