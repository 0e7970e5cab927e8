"""Semi-structured documents: lenient transcripts, story responses, override contracts, cues, plans, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import majority, top

SEGMENTS = "array<struct<start_ms:string,end_ms:string,text:string>>"


def write_segments(segments: DataFrame, by: str) -> DataFrame:
    """(by, document): each group's segments as a JSON array, in order."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    return segments.groupBy(by).agg(F.to_json(rows).alias("document"))


def read_segments(documents: DataFrame, by: str) -> DataFrame:
    """Segments of JSON arrays; rows whose times do not parse are skipped."""
    rows = documents.select(by, F.inline(F.from_json("document", SEGMENTS)))
    typed = rows.select(by, F.col("start_ms").try_cast("bigint").alias("start_ms"), F.col("end_ms").try_cast("bigint").alias("end_ms"), F.coalesce("text", F.lit("")).alias("text"))
    return typed.where("start_ms is not null and end_ms is not null")


def valid_moments(moments: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Moments with a start before their end and a description; missing indices become unused ones."""
    from .checks import fill_index

    good = moments.where((F.col("end_ms") > F.col("start_ms")) & (F.trim(F.coalesce("description", F.lit(""))) != ""))
    return fill_index(good, by, "candidate_index", order)


def story(answer: Column) -> Column:
    """A story response: titles under either name, a default score, a known type."""
    parsed = F.from_json(answer, "title string, main_title string, score double, shorts_type string, type string")
    kind = F.coalesce(parsed["shorts_type"], parsed["type"])
    return F.struct(
        F.coalesce(parsed["title"], parsed["main_title"], F.lit("")).alias("title"),
        F.coalesce(parsed["score"], F.lit(0.5)).alias("score"),
        F.when(kind.isin("highlight", "block", "normal"), kind).otherwise("normal").alias("shorts_type"),
    )


#: The stamps of an override document, the keys that only the newest may have, and the roles of its clips.
STAMPS = ("edit_overrides/v1", "edit_overrides/v2", "edit_overrides/v3")
NEWEST_KEYS, ROLES = ("images", "texts"), ("hook", "build", "payoff")


def override_reason(document: Column) -> Column:
    """ok, or the first thing that an override document breaks: its stamp, its title, then its clips, subtitles, narration,
    images and texts. Lists replace all there was, so an empty one is wrong, but for narration, where it means none."""
    at = lambda path: F.get_json_object(document, path)
    number = "start_sec:string,end_sec:string,source_time_sec:string,duration_sec:string,text:string,role:string,style:string"
    rows = lambda key: F.from_json(at(f"$.{key}"), f"array<struct<{number}>>")
    value = lambda c: c.try_cast("double")
    has = lambda key: F.array_contains(F.json_object_keys(document), key)
    newest = at("$.schema") == STAMPS[-1]

    def any_of(key: str, bad) -> Column:
        return F.coalesce(F.exists(rows(key), bad), F.lit(False))

    no_list = lambda key: has(key) & (at(f"$.{key}") != "null") & ~F.coalesce(F.ltrim(at(f"$.{key}")).startswith("["), F.lit(False))
    empty = lambda key: has(key) & (F.coalesce(F.size(rows(key)), F.lit(-1)) == 0)
    turned = lambda r: ~F.coalesce((value(r["start_sec"]) >= 0) & (value(r["start_sec"]) < value(r["end_sec"])), F.lit(False))
    blank = lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) == ""
    unplaced = lambda r: ~F.coalesce(value(r["source_time_sec"]) >= 0, F.lit(False))
    endless = lambda r: r["duration_sec"].isNotNull() & ~F.coalesce(value(r["duration_sec"]) > 0, F.lit(False))
    reason = F.when(F.json_object_keys(document).isNull(), "not an object").when(~F.coalesce(at("$.schema").isin(*STAMPS), F.lit(False)), "unknown schema")
    reason = reason.when(F.trim(at("$.title.top_title")) == "", "title: blank").when(at("$.title.segments").isNotNull() & ~newest, "title: segments need the newest schema")
    for key in ("clips", "subtitles", *NEWEST_KEYS):
        if key in NEWEST_KEYS:
            reason = reason.when(has(key) & ~newest, f"{key}: need the newest schema")
        reason = reason.when(no_list(key) | empty(key), f"{key}: not a list with rows")
        if key not in NEWEST_KEYS:
            reason = reason.when(any_of(key, turned), f"{key}: times")
    reason = reason.when(any_of("clips", lambda r: r["role"].isNotNull() & ~r["role"].isin(*ROLES)), "clips: role").when(any_of("subtitles", blank), "subtitles: blank")
    reason = reason.when(any_of("subtitles", lambda r: r["source_time_sec"].isNotNull() | r["style"].isNotNull()) & ~newest, "subtitles: anchors need the newest schema")
    reason = reason.when(no_list("tts"), "tts: not a list").when(any_of("tts", unplaced), "tts: time").when(any_of("tts", blank), "tts: blank").when(any_of("tts", endless), "tts: duration")
    for key in NEWEST_KEYS:
        reason = reason.when(any_of(key, lambda r: unplaced(r) | r["duration_sec"].isNull() | endless(r)), f"{key}: times")
    return reason.when(any_of("texts", blank), "texts: blank").otherwise("ok")


def apply_overrides(variants: DataFrame, override: DataFrame, key: str = "variant_id") -> DataFrame:
    """The override's clips in place of variant 0's, if it has any; other variants stay."""
    some = override.limit(1).select(F.lit(0).alias(key)).distinct()
    return variants.join(some, key, "left_anti").unionByName(override.withColumn(key, F.lit(0)).select(*variants.columns))


def normalise_cues(cues: DataFrame, by: Sequence[str], voices: Sequence[str], total: str, most: int = 5) -> DataFrame:
    """Cues in range, clamped to the total, in order, at most `most`, all in their group's commonest known voice."""
    good = cues.where((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col(total)) & (F.col("end_ms") > F.col("start_ms")))
    good = good.withColumn("end_ms", F.least("end_ms", total)).withColumn("voice", F.when(F.col("voice").isin(*voices), F.col("voice")).otherwise(voices[0]))
    first = top(good, by, [F.col("start_ms"), F.col("cue_idx")], most)
    voice = majority(first, by, "voice", "place").select(*by, F.col("voice").alias("_voice"))
    return first.join(voice, list(by)).withColumn("voice", F.col("_voice")).drop("_voice")


def merge_rules(base: Column, extra: Column) -> Column:
    """Rules of both lists, base first, each once; blank ones go."""
    bare = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(bare(base), bare(extra)))


def edit_plan(clips: DataFrame, by: str, order: str) -> DataFrame:
    """(by, plan): one JSON document a group, with its timeline in order."""
    row = F.struct(order, "role", "start_ms", "end_ms")
    return clips.groupBy(by).agg(F.to_json(F.struct(F.count("*").alias("clips"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.array_sort(F.collect_list(row)).alias("timeline"))).alias("plan"))


def slim(df: DataFrame) -> DataFrame:
    """Arrays become their sizes, long texts their lengths under n_<name>."""
    kinds = dict(df.dtypes)
    return df.select(*(F.size(c).alias(f"n_{c}") if k.startswith("array") else F.length(c).alias(f"n_{c}") if k == "string" else F.col(c) for c, k in kinds.items()))


def edge_text(edges: DataFrame, wording: dict[str, str]) -> DataFrame:
    """Edges with a line of text by their type."""
    words = F.create_map(*(x for k, v in wording.items() for x in (F.lit(k), F.lit(v))))
    return edges.withColumn("line", F.format_string("%s -> %s: %s", "a", "b", F.coalesce(F.try_element_at(words, F.col("type")), F.col("type"))))


def usage(df: DataFrame, by: Sequence[str], seconds: str, flag: str, rate: int, dearer: int) -> DataFrame:
    """Seconds with and without a flag, and the cost in micros at two rates a second."""
    part = lambda on: F.sum(F.when(F.col(flag) == on, F.col(seconds)).otherwise(0))
    return df.groupBy(*by).agg(part(False).alias("plain_s"), part(True).alias("flagged_s"), (part(False) * rate + part(True) * dearer).alias("cost"))


def silence_ratio(files: DataFrame, arm: str = "arm") -> DataFrame:
    """Of each arm: files, plain mean of the silence share and the mean by length, in permille."""
    share = F.expr("silent_ms * 1000 div total_ms")  # whole permille of a file, so that no sum depends on order
    return files.where("total_ms > 0").groupBy(arm).agg(F.count("*").alias("files"), F.floor(F.avg(share)).alias("mean"), F.floor(F.sum("silent_ms") / F.sum("total_ms") * 1000).alias("weighted"))


def score_floor(ranked: DataFrame, by: Sequence[str], rank: str, score: str, least: float = 0.4) -> DataFrame:
    """Rows of at least `least`; a group's first row stays whatever its score."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(rank)) == 1
    return ranked.withColumn("_first", first).where(F.col("_first") | (F.col(score) >= least)).drop("_first")
