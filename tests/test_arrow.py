import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.functions.arrow import ROWS, by_slices
from foliospark.operators.formula import formula_column, normalize_formulas


def test_formulas_hold_a_slice_of_a_batch():
    texts = pa.array(["at 30℃ " + "x" * 20_000] * 1000 + [None])
    tracemalloc.start()
    out = by_slices(normalize_formulas, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All of them as Python strings would take 80 MB with their results.
    assert peak < 16e6 and len(out) == 1001 and not out[1000].is_valid and out[999].as_py() == normalize_formulas(texts[999].as_py())


def test_formula_column_over_slices(spark):
    df = spark.range(0, 3 * ROWS + 1, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("at 30℃ "), F.col("id").cast("string"))).alias("t"))
    got = {r.id: r.n for r in df.select("id", formula_column(F.col("t")).alias("n")).collect()}
    assert got == {k: normalize_formulas(f"at 30℃ {k}") if k % 5 else None for k in range(3 * ROWS + 1)}
