"""Incremental parsing gives what one run gives, also when files come later."""

from foliospark.plans.pipeline import parse
from foliospark.sinks.markdown import render
from foliospark.sources.text import text_docset
from foliospark.streaming.ingest import line_counts, stream_parse, text_stream


def test_files_that_come_later_are_parsed_once(spark, tmp_path):
    docs = [(k, f"{k} A heading\n\nA line of text that goes\non in the next one, document {k}.") for k in range(6)]
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def add(part, name):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.parquet(f"{source}/{name}")
        stream_parse(text_stream(spark, f"{source}/*"), text_docset, out, at).awaitTermination()

    add(docs[:4], "a")
    add(docs[4:], "b")
    got = {r.doc_id: r.markdown for r in spark.read.parquet(out).collect()}
    want = {r.doc_id: r.markdown for r in render(parse(text_docset(spark.createDataFrame(docs, "doc_id long, text string")), geometry=False)).collect()}
    assert got == want and len(got) == 6 and spark.read.parquet(out).count() == 6


def test_windows_of_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = line_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()}
    want: dict = {}
    for r in events.select("ts", "event_type").collect():
        k = r.ts.replace(minute=0, second=0, microsecond=0), r.event_type
        want[k] = want.get(k, 0) + 1
    assert got == want
