"""Structured Streaming over event files: watermarked windows, sessions and latest states. Extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on streams and tables alike."""
    w = F.window("ts", size)
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(w, "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) per session of a user."""
    s = F.session_window("ts", gap)
    grouped = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy("user_id", s)
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def watch_folder(spark: SparkSession, source: str, schema: str, transform, sink: str, checkpoint: str, format: str = "parquet") -> None:
    """Processes the files that are new since the last call, each exactly once, and returns."""
    stream = spark.readStream.schema(schema).format(format).load(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
