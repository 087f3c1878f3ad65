"""An optional streaming intake of events: sessions by inactivity with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def streamed_sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions of users closed by ``gap`` without an event; events later than ``lateness`` are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    grouped = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.sum("value").alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "purchases", "value")


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
