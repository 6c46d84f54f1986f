"""Rules that read their own results run over the rows of one page or document at a time.

Rows are hashed and sorted by their keys once, and a partition's groups are taken one after the other out of its Arrow
batches: a group costs what its rows do, however many there are. Only the columns a rule works on become Python values; what a row has besides
stays in Arrow and follows it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from foliospark.model import PLACE
from foliospark.runtime import void_columns

_OUT = 4096
#: The number of the row whose other columns a row of the result has.
AT = "__at"


def fold(df: DataFrame, keys: tuple[str, ...], rule: Callable[[list[dict]], list[dict]], order: tuple[str, ...] = PLACE, schema=None, columns: tuple[str, ...] = (), together: bool = False, changes: tuple[str, ...] = ()) -> DataFrame:
    """rule() over each group's rows as dicts, in order; what it returns has the schema of df, unless another is given.

    columns, if given, are those the rule reads or writes, besides keys and order. The others go with the row that a result was copied or changed from.
    changes, if given, are those that it writes; what it only reads goes with the row, too.
    together says that the rows of a group are in one partition, as a window over the keys leaves them; they aren't moved then.
    """
    if not together:
        df = df.repartition(*keys)
    if columns:
        return _fold_some(df, keys, rule, order, columns, changes)
    out = schema or df.schema
    arrow = to_arrow_schema(out)

    def run(batches):
        done: list[dict] = []
        for group in _groups(((batch.to_pylist(), 0) for batch in batches), keys):
            done += rule(group)
            if len(done) >= _OUT:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _groups(parts, keys: tuple[str, ...]):
    """The rows of each group; parts are (rows, number of the first)."""
    group: list[dict] = []
    at = None
    for rows, first in parts:
        for number, row in enumerate(rows, first):
            row[AT] = number
            key = tuple(row[k] for k in keys)
            if key != at:
                if group:
                    yield group
                group, at = [], key
            group.append(row)
    if group:
        yield group


def _fold_some(df: DataFrame, keys, rule, order, columns, changes) -> DataFrame:
    seen = [c for c in df.columns if c in {*keys, *order, *columns}]
    # What is null in every row is put back after the rule.
    void = void_columns(df)
    unsaid = [c for c in seen if c in void]
    rest = [c for c in df.columns if c not in seen and c not in void]
    # Spark 4.1 goes over a batch's null lists and maps again for each row it adds, so they are sent empty, with a mark.
    bare = {c: F.col(f"`{c}`").isNull() for c in df.columns if c not in void and isinstance(df.schema[c].dataType, (ArrayType, MapType))}
    empty = lambda c: (F.array() if isinstance(df.schema[c].dataType, ArrayType) else F.create_map()).cast(df.schema[c].dataType)
    sent = lambda c: F.coalesce(F.col(f"`{c}`"), empty(c)).alias(c) if c in bare else F.col(f"`{c}`")
    marked = [c for c in seen if c in bare]
    given = [c for c in seen if c not in void]
    rows = df.select(*map(sent, given), *(bare[c].alias(f"__null {k}") for k, c in enumerate(marked)), F.struct(*map(sent, rest), *(bare[c].alias(f"__null {k}") for k, c in enumerate(rest) if c in bare), F.lit(0).alias("__one")).alias("__rest"))
    width = len(rows.columns) - 1
    changed = [c for c in seen if not changes or c in changes or c in bare]
    kept = [c for c in given if c not in changed]
    follows = [*(rows.columns.index(c) for c in kept), width]
    part = StructType([df.schema[c] for c in changed])
    arrow = to_arrow_schema(part)

    def run(batches):
        held: list[pa.RecordBatch] = []
        start = end = 0

        def parts():
            nonlocal end
            for batch in batches:
                first, end = end, end + batch.num_rows
                held.append(batch.select(follows))
                rows = batch.select(range(width)).to_pylist()
                for row in rows:
                    for k, c in enumerate(marked):
                        if row.pop(f"__null {k}"):
                            row[c] = None
                    for c in unsaid:
                        row[c] = None
                yield rows, first

        def written(done):
            """The rows of done with what goes with them; what no later row can need is let go."""
            nonlocal start
            which = pa.array([r[AT] - start for r in done], pa.int64())
            found = [(held[0].column(k) if len(held) == 1 else pa.concat_arrays([b.column(k) for b in held])).take(which) for k in range(len(follows))]
            while len(held) > 1 and start + held[0].num_rows <= done[-1][AT]:
                start += held.pop(0).num_rows
            made = pa.RecordBatch.from_pylist(done, schema=arrow)
            return pa.RecordBatch.from_arrays([*made.columns, *found], [*changed, *kept, "__rest"])

        done: list[dict] = []
        for group in _groups(parts(), keys):
            done += rule(group)
            if len(done) >= _OUT:
                yield written(done)
                done = []
        if done:
            yield written(done)

    folded = rows.sortWithinPartitions(*keys, *order).mapInArrow(run, StructType([*part.fields, *(df.schema[c] for c in kept), StructField("__rest", rows.schema["__rest"].dataType)]))

    def put(c):
        if c in changed or c in kept:
            return F.col(f"`{c}`")
        if c in void:
            return F.lit(None).cast(df.schema[c].dataType)
        return F.when(~F.col(f"__rest.`__null {rest.index(c)}`"), F.col(f"__rest.`{c}`")) if c in bare else F.col(f"__rest.`{c}`")

    return folded.select(*(put(c).alias(c) for c in df.columns))
