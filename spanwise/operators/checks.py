"""Checks on timed rows and documents: reasons instead of failures, one column each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip_reason(start: Column, end: Column, total: Column, least: int) -> Column:
    """The first thing wrong with a clip, or ok."""
    return (
        F.when(start.isNull() | end.isNull(), "no times").when(start < 0, "before start").when(end <= start, "empty")
        .when(end - start < least, "too short").when(end > total, "past end").otherwise("ok")
    )


def fate(start: Column, end: Column, total: Column, slack: int = 3000, least: int = 200) -> Column:
    """What becomes of a clip: ok, moved (a start below 0, or an end up to `slack` past the total, null or 0 for an unknown one), or why it goes."""
    known = F.when(total > 0, total)
    first, last = F.greatest(start, F.lit(0)), F.least(end, F.coalesce(known, end))
    return (
        F.when(start.isNull() | end.isNull(), "no times").when(end > known + slack, "past end").when(first >= known, "starts past end")
        .when(last - first < least, "too short").when((first != start) | (last != end), "moved").otherwise("ok")
    )


def sanitise(df: DataFrame, total: Column, slack: int = 3000, least: int = 200) -> DataFrame:
    """Clips with possible times by fate(): starts below 0 become 0, ends up to `slack` past the total are clamped,
    what is farther off, starts past the total or lasts under `least` goes."""
    good = df.where(fate(F.col("start_ms"), F.col("end_ms"), total, slack, least).isin("ok", "moved"))
    return good.withColumns({"start_ms": F.greatest("start_ms", F.lit(0)), "end_ms": F.least("end_ms", F.coalesce(F.when(total > 0, total), F.col("end_ms")))})


def windows(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """How many windows of a group overlap the one before, or are empty; and whether they are too many."""
    before = F.lag("end_ms").over(Window.partitionBy(*by).orderBy(*order))
    marked = df.withColumn("_before", before)
    return marked.groupBy(*by).agg(
        F.count_if(F.col("_before") > F.col("start_ms")).alias("overlapping"),
        F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("empty"),
        (F.count("*") > most).alias("too_many"),
    )


def unknown_keys(document: Column, known: Sequence[str]) -> Column:
    """Keys of a JSON object that the contract does not have."""
    return F.array_except(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def absolute(df: DataFrame, chunk: Sequence[str], chunk_start: str, chunk_length: str, slack: int = 1000) -> DataFrame:
    """Chunk-relative times moved to the source's axis, unless a chunk's times are absolute already."""
    already = F.max("end_ms").over(Window.partitionBy(*chunk)) > F.col(chunk_length) + slack
    shift = F.when(already, 0).otherwise(F.col(chunk_start))
    return df.withColumns({"start_ms": F.col("start_ms") + shift, "end_ms": F.col("end_ms") + shift})


def extension(candidate_start: Column, candidate_end: Column, ext: Column, chunk_start: Column, chunk_end: Column, slack: int = 500) -> Column:
    """A context extension that holds its candidate and lies in its chunk, else one that is not needed."""
    fits = (ext["start_ms"] <= candidate_start) & (ext["end_ms"] >= candidate_end) & (ext["start_ms"] >= chunk_start - slack) & (ext["end_ms"] <= chunk_end + slack)
    return ext.withField("needed", ext["needed"] & F.coalesce(fits, F.lit(False)))


def fill_index(df: DataFrame, by: Sequence[str], index: str, order: str) -> DataFrame:
    """Missing indices become unused ones, above the group's largest, in order."""
    w = Window.partitionBy(*by)
    place = F.sum(F.when(F.col(index).isNull(), 1).otherwise(0)).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    top = F.coalesce(F.max(index).over(w), F.lit(-1))
    return df.withColumn(index, F.coalesce(F.col(index), (top + place).cast(df.schema[index].dataType)))


def clean_beats(beats: Column, shift: Column) -> Column:
    """Beats (structs of start_sec and end_sec as text, and more) with times in ms, shifted; those without a length go."""
    ms = lambda c: F.floor(c.try_cast("double") * 1000 + 0.5).cast("long") + shift
    timed = F.transform(beats, lambda b: b.withField("start_ms", ms(b["start_sec"])).withField("end_ms", ms(b["end_sec"])).dropFields("start_sec", "end_sec"))
    return F.filter(timed, lambda b: b["end_ms"] > b["start_ms"])


def without_intro(moments: DataFrame, flag: str = "is_intro_credits") -> DataFrame:
    """Moments that are not marked as intro or credits."""
    return moments.where(~F.coalesce(F.col(flag), F.lit(False)))


def output_reason(seconds: Column, least: float, most: float, peak_db: Column, black_s: Column, loudest: float = -1.0, blackest: float = 0.5) -> Column:
    """ok, or the first thing a finished file breaks: its length, its peak, a black run."""
    return F.when(~F.coalesce(seconds.between(least, most), F.lit(False)), "length").when(peak_db > loudest, "peak").when(black_s > blackest, "black").otherwise("ok")


def editorial_reason(document: Column, known: Sequence[str] = ("avoid", "rules", "prefer", "tone")) -> Column:
    """ok, or what is wrong with an editorial guide; keys that start with _ are notes."""
    extra = F.filter(unknown_keys(document, known), lambda k: ~k.startswith("_"))
    return F.when(F.json_object_keys(document).isNull(), "not an object").when(F.size(extra) > 0, F.concat(F.lit("unknown key "), F.array_min(extra))).otherwise("ok")
