"""Session settings that more than one part of the library needs."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master, and an error on any other.

    An executor of a cluster would write into its own machine's temporary folder, where no other finds it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        sc.setCheckpointDir(named)
        _delete(spark, named, at_exit=True)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        store.deleteOnExit(where)
    else:
        store.delete(where, True)


#: Rows that lie together by doc_id are joined by doc_id and more where they are. By default each set of keys moves both sides again.
_TOGETHER = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def whole_documents(spark: SparkSession):
    """Plans made within keep tables where they lie, if they are parted by doc_id, for joins whose keys have doc_id among them."""
    before = spark.conf.get(_TOGETHER)
    spark.conf.set(_TOGETHER, "false")
    try:
        yield
    finally:
        spark.conf.set(_TOGETHER, before)


_BETWEEN = "\x01"
_NULL = re.compile(r"null AS .+#(\d+)L?", re.S)
_ID = re.compile(r".+#(\d+)L?", re.S)


def _ids(attributes) -> list[str]:
    return [m[1] if (m := _ID.fullmatch(x)) else "" for x in attributes.mkString(_BETWEEN).split(_BETWEEN)]


def _void(plan) -> set[str]:
    """The ids of attributes that a plan says are null in each row. An id is the same value, or null, wherever it occurs, but a union has those of its first branch."""
    branches = plan.children()
    branches = [branches.apply(k) for k in range(branches.size())]
    if plan.nodeName() == "Union":
        each = [(_ids(b.output()), _void(b)) for b in branches]
        return {i for k, i in enumerate(_ids(plan.output())) if all(ids[k] in void for ids, void in each)}
    out = set().union(*map(_void, branches))
    if plan.nodeName() == "Project":
        made = plan.projectList()
        # A text may read null as well; it isn't nullable.
        out |= {m[1] for k, x in enumerate(made.mkString(_BETWEEN).split(_BETWEEN)) if (m := _NULL.fullmatch(x)) and made.apply(k).nullable()}
    return out


def void_columns(df: DataFrame) -> set[str]:
    """Columns that are null in every row as the plan has it; rows needn't carry them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    void = _void(plan)
    return {c for c, i in zip(df.columns, _ids(plan.output()), strict=True) if i in void}


def reads_once(df: DataFrame, given: DataFrame) -> bool:
    """Whether df, made of given, goes over what given reads no more often than given itself does: what was worked out for given isn't worked out again."""
    leaves = lambda x: x._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    return leaves(df) <= leaves(given)


def materialise(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and a lost executor costs nothing.

    The table goes when the driver ends, or before that by :func:`discard`. narrow leaves out columns that are null throughout: they
    come back as constants, so that no later exchange or sort moves them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    void = void_columns(df) if narrow else set()
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in void)) if 0 < len(void) < len(df.columns) else df
    with whole_documents(spark):
        kept.write.parquet(path)
    _delete(spark, path, at_exit=True)
    stored = spark.read.schema(kept.schema).parquet(path)
    if kept is not df:
        stored = stored.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in df.schema.fields))
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` returned and that nothing will read again; other ones stay as they are."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            _delete(df.sparkSession, path)
