"""Columns of boxes: struct<x0, y0, x1, y1>, null where an element has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def null_if_zero(b: Column) -> Column:
    """Null for the box of four zeros, which stands for none in element files."""
    return F.when(~((b.x0 == 0) & (b.y0 == 0) & (b.x1 == 0) & (b.y1 == 0)), b)


def width(b: Column) -> Column:
    return b.x1 - b.x0


def height(b: Column) -> Column:
    return b.y1 - b.y0


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def center_x(b: Column) -> Column:
    return (b.x0 + b.x1) / 2


def center_y(b: Column) -> Column:
    return (b.y0 + b.y1) / 2


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_of_inner(inner: Column, outer: Column) -> Column:
    """The share of inner's area within outer; 0 for an empty one."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """The shared area against the smaller of both, taken as 1 at least."""
    return intersection(a, b) / F.least(F.greatest(width(a) * height(a), F.lit(1.0)), F.greatest(width(b) * height(b), F.lit(1.0)))


def x_share(b: Column, left: Column, right: Column) -> Column:
    """The share of b's own width, taken as 1 at least, between left and right."""
    return F.greatest(F.least(b.x1, right) - F.greatest(b.x0, left), F.lit(0.0)) / F.greatest(width(b), F.lit(1.0))


def gap_below(a: Column, b: Column) -> Column:
    """From the bottom of a to the top of b; negative if they overlap."""
    return b.y0 - a.y1


def gap_between(a: Column, b: Column) -> Column:
    return F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)))


def padded(b: Column, ratio: float = 0.1) -> Column:
    return box(b.x0 - width(b) * ratio, b.y0 - height(b) * ratio, b.x1 + width(b) * ratio, b.y1 + height(b) * ratio)


def holds(b: Column, x: Column, y: Column) -> Column:
    return x.between(b.x0, b.x1) & y.between(b.y0, b.y1)
