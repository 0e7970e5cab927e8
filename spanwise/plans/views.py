"""Timed rows derived from the driver tables, in integer milliseconds, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    of_day = F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
    return days * 86_400_000 + of_day + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as speech segments: 10 ms a character, gaps of 0, 400 or 800 ms before a turn."""
    base = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text",
        (F.length("text") * 10).cast("long").alias("dur_ms"), ((F.col("turn") % 3) * 400).cast("long").alias("gap_ms"),
    )
    before = Window.partitionBy("source_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gap_ms") + F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0))
    timed = base.withColumn("start_ms", start.cast("long"))
    return timed.select("source_id", "seg_idx", "speaker", "text", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))


SEGMENTS = """segments as (
  select source_id, seg_idx, speaker, text, cast(start_ms as bigint) as start_ms, cast(start_ms + dur_ms as bigint) as end_ms from (
    select conv_id as source_id, turn as seg_idx, role as speaker, text, length(text) * 10 as dur_ms,
           (turn % 3) * 400 + coalesce(sum(length(text) * 10 + (turn % 3) * 400) over (
             partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as start_ms
    from conversations))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidate moments of their user, as long as their value says."""
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("source_id"), F.col("event_id").alias("cand_idx"), epoch_ms(F.col("ts")).alias("start_ms"),
                F.floor(F.col("value") * 600_000).cast("long").alias("dur_ms"), ((F.col("event_id") * 7919) % 1000).alias("score"), F.col("event_type").alias("kind"))
        .select("source_id", "cand_idx", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"), "score", "kind")
    )


CANDIDATES = """candidates as (
  select user_id as source_id, event_id as cand_idx, epoch_us(ts::timestamp) // 1000 as start_ms,
         epoch_us(ts::timestamp) // 1000 + cast(floor(value * 600000) as bigint) as end_ms, (event_id * 7919) % 1000 as score, event_type as kind
  from events)"""
