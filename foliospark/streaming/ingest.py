"""Incremental parsing by Structured Streaming: documents don't depend on each other, so each micro-batch is a run of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.model import DocSet
from foliospark.plans.pipeline import Config, parse
from foliospark.sinks.markdown import render


def stream_parse(source: DataFrame, to_docset: Callable[[DataFrame], DocSet], folder: str, checkpoint: str, config: Config | None = None, geometry: bool = False, available_now: bool = True) -> StreamingQuery:
    """Parse each micro-batch of a streaming source and put its Markdown below folder, in a directory of the batch's number.

    A batch that is run again after a failure overwrites its own directory, so each document is there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        render(parse(to_docset(batch), config, geometry)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    w = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def line_counts(stream: DataFrame, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n) of events by tumbling windows, with a watermark: for the warnings and page counts of a running ingest."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
