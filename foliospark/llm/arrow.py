"""What the operators share to look at the text column of an Arrow batch without making Python strings of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator works on, whatever else docs has."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row k is bytes[offsets[k]:offsets[k + 1]]; null rows are empty. offsets start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if offs is None or data is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """(first, end) rows, of about ``most`` bytes each and of one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(end, n)
        first = end


def runs(batches, keys: int):
    """(the first ``keys`` columns, as integers, and the rows) of each run of rows that agree in them, batch by batch."""
    for batch in batches:
        found = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(max(0, batch.num_rows - 1), bool)
        for f in found:
            new |= f[1:] != f[:-1]
        cuts = (np.flatnonzero(new) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if e > s:
                yield tuple(int(f[s]) for f in found), batch.slice(s, e - s)
