"""Markdown tables as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.let import let
from foliospark.functions.text import py_strip, solid_lines

SEPARATOR = r"(?U)^\|?[\s:|-]+(?:\|[\s:|-]+)+\|?\z"


def split_row(line: Column) -> Column:
    """Stripped cells between pipes, those at the ends left out."""
    inner = F.regexp_replace(F.regexp_replace(py_strip(line), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|", -1), py_strip)


def parse_table(content: Column) -> Column:
    """struct<header array<string>, separator array<string>, rows array<array<string>>>; null for fewer than two lines."""
    def parts(ls: Column) -> Column:
        second, header = F.get(ls, F.lit(1)), split_row(F.get(ls, F.lit(0)))
        separated = second.rlike(SEPARATOR)
        skip = F.when(separated, 2).otherwise(1)
        rows = F.transform(F.slice(ls, skip + 1, F.greatest(F.size(ls) - skip, F.lit(0))), split_row)
        dashes = F.transform(header, lambda _: F.lit("---"))
        return F.when(F.size(ls) >= 2, F.struct(header.alias("header"), F.when(separated, split_row(second)).otherwise(dashes).alias("separator"), rows.alias("rows")))

    return let(solid_lines(content), parts)


def build_table(header: Column, separator: Column, rows: Column) -> Column:
    """Markdown of a table, each row cut or filled to the header's width."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))
    body = F.transform(rows, lambda r: row(fit(r)))
    return F.array_join(F.concat(F.array(row(header), F.concat(F.lit("|"), F.array_join(separator, "|"), F.lit("|"))), body), "\n")


def is_degenerate(content: Column) -> Column:
    """Tables without information: all blank, or up to 3 x 3 without digits, with the header twice and a blank last row."""
    return let(parse_table(content), lambda t: let(F.concat(F.array(t.header), t.rows), lambda every: _degenerate(t, every)))


def _degenerate(t: Column, every: Column) -> Column:
    low = F.transform(every, lambda r: F.transform(r, F.lower))
    cells = F.flatten(low)
    solid = F.filter(cells, lambda c: F.length(c) > 0)
    small = (F.size(every) <= 3) & (F.size(t.header) <= 3)
    last_blank = (F.size(t.rows) > 0) & ~F.exists(F.element_at(every, -1), lambda c: F.length(c) > 0)
    shell = ~F.exists(solid, lambda c: c.rlike(r"(?U)\d")) & (F.get(low, F.lit(0)) == F.get(low, F.lit(1))) & last_blank & (F.size(F.array_distinct(solid)) <= 3) & ((F.size(cells) - F.size(solid)) / F.size(cells) >= 0.25)
    return F.coalesce(small & ((F.size(solid) == 0) | shell), F.lit(False))


def column_count(content: Column) -> Column:
    """Columns of the first line with pipes that isn't a separator; 1 if there is none."""
    rows = F.filter(solid_lines(content), lambda x: x.startswith("|") & ~x.rlike(r"(?U)^[|\s:-]+\z"))
    first = F.get(rows, F.lit(0))
    return F.coalesce(F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1, F.lit(1))


def table_shape(content: Column) -> Column:
    """struct<rows int, cols int> of the lines with pipes; null for fewer than two."""
    rows = F.filter(solid_lines(content), lambda x: x.startswith("|"))
    cols = F.size(F.split(F.regexp_replace(F.get(rows, F.lit(0)), r"^\|+|\|+\z", ""), r"\|", -1))
    return F.when(F.size(rows) >= 2, F.struct(F.greatest(F.size(rows) - 2, F.lit(0)).alias("rows"), cols.alias("cols")))
