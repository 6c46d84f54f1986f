"""Documents are brought together once, not again for each join that has doc_id among its keys."""

import pytest

from foliospark.model import DOC, ELEMENT, PAGE, DocSet, complete
from foliospark.operators.chapter import coherent_numbering
from foliospark.operators.header_footer import strip_headers_footers
from foliospark.runtime import whole_documents

_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.mark.parametrize("stage", [coherent_numbering, strip_headers_footers])
def test_rows_move_less_often(spark, stage):
    e = complete(spark.range(10).selectExpr("id doc_id", "1 page_number", "0d seq", "'text' type", "'a' content"), ELEMENT)
    d = DocSet(complete(e.select("doc_id"), DOC), complete(e.selectExpr("doc_id", "page_number", "612d width", "792d height"), PAGE), e)
    moved = lambda: stage(d).elements._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = moved()
        with whole_documents(spark):
            together = moved()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert together < apart
    assert spark.conf.get(_KEYS) == "true"
