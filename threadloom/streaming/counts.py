"""Incremental counts over an event stream. An extension: the batch programs this engine follows have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_degrees(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Per window and event type: events and approximate distinct users; late rows beyond ``lateness`` are dropped by the watermark."""
    marked = events.withWatermark("ts", lateness)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users")).select("w.start", "w.end", "event_type", "events", "users")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is available to Parquet and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
