"""Streams: captures as they arrive, windows over events, bounded batches of client events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_captures(spark: SparkSession, folder: str, schema, files_at_once: int = 100) -> DataFrame:
    """Parquet deliveries below a folder as a stream; each file is taken once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def each_increment(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch to `apply` (an incremental operator); restarts continue where they stopped."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """(start, event_type, n, value): counts and sums per window; works on a stream (with watermark) and on a table."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.window(at, size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """(user_id, start, end, n): sessions by inactivity."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(at, gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def bounded_batches(events: DataFrame, at_most: int = 80, at: str = "ts") -> DataFrame:
    """(event_id, batch): the first `at_most` events of a user in each minute; what comes beyond is dropped at the source, as clients do."""
    w = Window.partitionBy("user_id", "batch").orderBy(at, "event_id")
    return events.withColumn("batch", F.date_trunc("minute", at)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= at_most).select("event_id", "batch")


def only_new(delivery: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a delivery that aren't there yet, each once."""
    return delivery.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")
