"""Narration cues anchored to clips: a clip's number and an offset in it, or, in older answers, a time on the edited axis
that is traced back through the clips' prefix sums. Times are integer milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import HOUR, edit_axis, overlap_join
from .ranking import majority

#: Known voices and speeds, the first of each standing for unknown ones, and how far beside the axis a time may lie.
VOICES = ("ko_female", "ko_female_high", "ko_male", "ko_male_low", "chat_emma", "chat_brian", "chat_seraphina", "chat_florian")
SPEEDS = ("normal", "very_slow", "slow", "fast", "very_fast")
BESIDE = 500


def inverse_axis(points: DataFrame, clips: DataFrame, by: Sequence[str], key: str, at: str, beside: int = BESIDE) -> DataFrame:
    """points (by, key, at on the edited axis) with clip_idx and offset_ms of the clip that plays then: the last clip that starts at
    or before. Times up to `beside` off the axis count to its ends; points farther off go, and so do those without clips.

    clips: by, clip_idx, start_ms, end_ms. Each clip owns the axis from its start to the next clip's, the last one to the end, so
    that a point meets one clip of its time cells, and clips of no length but for the last none."""
    lengths = clips.withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    axis = edit_axis(lengths, by, ["clip_idx"])
    w = Window.partitionBy(*by)
    following = F.lead("edit_start").over(w.orderBy("clip_idx"))
    total = F.sum(F.col("end_ms") - F.col("start_ms")).over(w)
    owned = axis.withColumns({"_next": following, "_total": total}).select(*by, "clip_idx", "edit_start", F.coalesce("_next", F.col("_total") + beside).alias("_to"))
    moved = points.where(F.col(at) >= -beside).select(*by, key, F.greatest(F.col(at), F.lit(0)).alias("_at"))
    met = overlap_join(moved.withColumn("_after", F.col("_at") + 1), owned, by, HOUR, "inner", "_at", "_after", "edit_start", "_to")
    return met.select(*by, key, "clip_idx", (F.col("_at") - F.col("edit_start")).alias("offset_ms"))


def anchored(cues: DataFrame, clips: DataFrame, by: Sequence[str], key: str, most: int = 5, voices: Sequence[str] = VOICES, speeds: Sequence[str] = SPEEDS) -> DataFrame:
    """(by, key, place, clip_index, offset_ms, dur_ms, source_ms, chunk_index, candidate_index, text, voice, speed): cues with their place in
    the source, in order of clip and offset (then key), at most `most` of a group.

    cues: by, key, text, voice, speed, clip_index and offset_ms with dur_ms, or, where one of the first two is null, start_ms and end_ms on the edited
    axis. Offsets are clamped to the clip; cues of clips that do not exist, without a length or without a text (null) go. All of a group speak in
    the commonest voice, counted before the group is cut; the first of equally common ones. clips: by, clip_idx, times, chunk_index, candidate_index."""
    told = cues.where("text is not null").withColumn("_new", F.col("clip_index").isNotNull() & F.col("offset_ms").isNotNull())
    old = told.where("not _new and end_ms > start_ms")
    traced = inverse_axis(old.select(*by, key, "start_ms"), clips, by, key, "start_ms")
    back = old.drop("clip_index", "offset_ms", "dur_ms").join(traced.withColumnRenamed("clip_idx", "clip_index"), [*by, key]).withColumn("dur_ms", F.col("end_ms") - F.greatest("start_ms", F.lit(0)))
    columns = [*by, key, "text", "voice", "speed", "clip_index", "offset_ms", "dur_ms"]
    every = told.where("_new").select(*columns).unionByName(back.select(*columns)).where("dur_ms > 0")
    known = clips.select(*by, F.col("clip_idx").alias("clip_index"), F.col("start_ms").alias("_s"), F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("_len"), "chunk_index", "candidate_index")
    placed = every.join(known, [*by, "clip_index"]).withColumn("offset_ms", F.least(F.greatest("offset_ms", F.lit(0)), "_len"))
    label = lambda c, names: F.when(F.col(c).isin(*names), F.col(c)).otherwise(names[0]).alias(c)
    placed = placed.select(*by, key, "clip_index", "offset_ms", "dur_ms", (F.col("_s") + F.col("offset_ms")).alias("source_ms"), "chunk_index", "candidate_index", F.trim("text").alias("text"), label("voice", voices), label("speed", speeds))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("clip_index", "offset_ms", key)) - 1)
    voice = majority(placed, by, "voice", "place").select(*by, F.col("voice").alias("_voice"))
    cut = placed.where(F.col("place") < most).join(voice, list(by))
    return cut.withColumn("voice", F.col("_voice")).select(*by, key, "place", "clip_index", "offset_ms", "dur_ms", "source_ms", "chunk_index", "candidate_index", "text", "voice", "speed")
