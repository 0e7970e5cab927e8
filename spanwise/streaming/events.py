"""Streams of events, beyond the batch operators: sessions and windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they arrive; times become zoned, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed `late` after their end."""
    spans = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return spans.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_values(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of each event type by tumbling window."""
    cut = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size).alias("w"))
    return cut.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
