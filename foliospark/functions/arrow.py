"""Python over Arrow batches, of which only some rows at a time are Python objects."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are Python objects at once.
ROWS = 64


def by_slices(rule: Callable[[str], str], texts: pa.Array) -> pa.Array:
    out = [pa.array([], pa.string())]
    for at in range(0, len(texts), ROWS):
        out.append(pa.array([None if x is None else rule(x) for x in texts.slice(at, ROWS).to_pylist()], pa.string()))
    return pa.concat_arrays(out)


def text_column(rule: Callable[[str], str], c: Column) -> Column:
    """rule() of each text of a column; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return by_slices(rule, texts)

    return F.arrow_udf(run, T.StringType())(c)


def shared(a: str, b: str) -> int:
    """How many characters two texts share, each as often as both have it. Work is in proportion to their lengths."""
    if a.isascii():
        return sum(min(a.count(c), b.count(c)) for c in set(a))
    theirs = Counter(b)
    return sum(min(n, theirs[c]) for c, n in Counter(a).items())


def shared_chars(a: Column, b: Column) -> Column:
    """shared() of two columns of texts; null has no characters."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [pa.array([], pa.int64())]
        for at in range(0, len(a), ROWS):
            pairs = zip(a.slice(at, ROWS).to_pylist(), b.slice(at, ROWS).to_pylist(), strict=True)
            out.append(pa.array([shared(x or "", y or "") for x, y in pairs], pa.int64()))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, T.LongType())(a, b)
