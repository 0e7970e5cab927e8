"""Operators on clips of an edit: lookups and restores, branches of a storyline, snapping and extension,
cue and subtitle placement, silence decisions. Times are integer milliseconds of the source, edit_start a
clip's start on the edited timeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import last_wins
from .intervals import HOUR, absorb_short, edit_axis, overlap, overlap_join, remap, union

KEY = ("chunk_index", "candidate_index")


def lookup(candidates: DataFrame, order: str) -> DataFrame:
    """Candidates with both indices, the last of each key."""
    return last_wins(candidates.where("chunk_index >= 0 and candidate_index >= 0"), KEY, order)


def restore_times(clips: DataFrame, candidates: DataFrame, aliases: DataFrame | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Clips with times, description and the columns `carried` of their candidate; aliases (chunk_index, candidate_index, to_chunk,
    to_candidate) redirect once. Clips without a candidate stay as they are."""
    if aliases is not None:
        clips = clips.join(aliases, list(KEY), "left").withColumns({"_c": F.coalesce("to_chunk", "chunk_index"), "_k": F.coalesce("to_candidate", "candidate_index")}).drop("to_chunk", "to_candidate")
    else:
        clips = clips.withColumns({"_c": F.col("chunk_index"), "_k": F.col("candidate_index")})
    known = candidates.select(F.col("chunk_index").alias("_c"), F.col("candidate_index").alias("_k"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("description").alias("_d"), *(F.col(c).alias(f"_of_{c}") for c in carried))
    joined = clips.join(known, ["_c", "_k"], "left")
    hit = F.col("_s").isNotNull()
    new = {
        "chunk_index": F.when(hit, F.col("_c")).otherwise(F.col("chunk_index")),
        "candidate_index": F.when(hit, F.col("_k")).otherwise(F.col("candidate_index")),
        "start_ms": F.coalesce("_s", "start_ms"),
        "end_ms": F.coalesce("_e", "end_ms"),
        "description": F.coalesce(F.when(F.col("_d") != "", F.col("_d")), "description"),
    }
    new |= {c: F.when(hit, F.col(f"_of_{c}")).otherwise(F.col(c)) for c in carried}
    return joined.withColumns(new).drop("_c", "_k", "_s", "_e", "_d", *(f"_of_{c}" for c in carried))


PIECE = "struct<start_ms:bigint,end_ms:bigint,chunk_index:bigint,candidate_index:bigint>"


def storyline_clips(stories: DataFrame) -> DataFrame:
    """Rows (variant_id, clip_idx, role, start_ms, end_ms) of storylines, one branch each: a highlight is a payoff alone; a
    block is its hook and its pieces in order of time, the last of them the payoff; with a hook_preview that lies in the
    hook and lasts a second, the preview is the hook, and the hook itself goes into a payoff that it overlaps, or is a
    build before it, unless it is the preview's own candidate; else hook, builds and payoff stay as they are.

    stories: variant_id, hook, payoff and an array build, and if they have them highlight, hook_preview and an array block,
    structs of start_ms, end_ms, chunk_index and candidate_index (-1 for none)."""
    for name, kind in (("highlight", PIECE), ("hook_preview", PIECE), ("block", f"array<{PIECE}>")):
        if name not in stories.columns:
            stories = stories.withColumn(name, F.lit(None).cast(kind))
    none = F.array().cast("array<struct<role:string,start_ms:bigint,end_ms:bigint>>")
    part = lambda role, start, end: F.struct(F.lit(role).alias("role"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))
    one = lambda role, c: F.when(c.isNotNull(), F.array(part(role, c["start_ms"], c["end_ms"]))).otherwise(none)
    hook, preview, payoff = F.col("hook"), F.col("hook_preview"), F.col("payoff")
    builds = F.coalesce(F.transform("build", lambda b: part("build", b["start_ms"], b["end_ms"])), none)
    inside = (hook["start_ms"] <= preview["start_ms"]) & (preview["end_ms"] <= hook["end_ms"]) & (preview["end_ms"] - preview["start_ms"] >= 1000)
    meet = F.coalesce((payoff["start_ms"] < hook["end_ms"]) & (hook["start_ms"] < payoff["end_ms"]), F.lit(False))
    same = hook["chunk_index"].eqNullSafe(preview["chunk_index"]) & hook["candidate_index"].eqNullSafe(preview["candidate_index"])
    wide = F.array(part("payoff", F.least(payoff["start_ms"], hook["start_ms"]), F.greatest(payoff["end_ms"], hook["end_ms"])))
    previewed = F.concat(one("hook", preview), builds, F.when(meet, wide).otherwise(F.concat(F.when(same, none).otherwise(one("build", hook)), one("payoff", payoff))))
    sorted_block = F.array_sort("block")  # by start
    block = F.transform(sorted_block, lambda c, i: part("build", c["start_ms"], c["end_ms"]).withField("role", F.when(i == F.size("block") - 1, "payoff").otherwise("build")))
    every = (
        F.when(F.col("highlight").isNotNull(), one("payoff", F.col("highlight"))).when(F.col("block").isNotNull(), F.concat(one("hook", hook), block))
        .when(F.coalesce(inside, F.lit(False)), previewed).otherwise(F.concat(one("hook", hook), builds, one("payoff", payoff)))
    )
    return stories.select("variant_id", F.posexplode(every).alias("clip_idx", "c")).select("variant_id", "clip_idx", "c.role", "c.start_ms", "c.end_ms")


def flatten_pieces(clips: DataFrame) -> DataFrame:
    """A row a kept piece (array `pieces` of structs); subtitle and tts_draft stay on the first only."""
    out = clips.select("*", F.posexplode("pieces").alias("piece_idx", "_p"))
    first = lambda c: F.when(F.col("piece_idx") == 0, F.col(c)).otherwise("")
    return out.withColumns({"start_ms": F.col("_p.start_ms"), "end_ms": F.col("_p.end_ms"), "subtitle": first("subtitle"), "tts_draft": first("tts_draft")}).drop("_p", "pieces")


def at_speed(df: DataFrame, speed: float) -> DataFrame:
    """Times on the output axis; the same rows at 1.0."""
    if speed == 1.0:
        return df
    return df.withColumns({c: F.floor(F.col(c) / speed + 0.5).cast("long") for c in ("start_ms", "end_ms")})


def filter_flagged(df: DataFrame, flags: str = "flags") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows with a flag that is not blank are dropped."""
    hit = F.coalesce(F.exists(flags, lambda x: F.trim(x) != ""), F.lit(False))
    return df.where(~hit), df.where(hit)


def outside_zones(df: DataFrame, intro_end: Column, credits_start: Column) -> DataFrame:
    """Rows whose middle lies between the intro's end and the credits' start (null: no such zone)."""
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    return df.where(F.coalesce(middle >= intro_end, F.lit(True)) & F.coalesce(middle < credits_start, F.lit(True)))


def choose(name: Column, known: dict[str, str], default: str | None = None) -> Column:
    """A known name's value; of an unknown one the default's, or an error where there is none."""
    value = F.lit(None).cast("string")
    for k, v in known.items():
        value = F.when(name == k, v).otherwise(value)
    if default is None:
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(name, F.lit("null")))))
    return F.coalesce(value, F.lit(known[default]))


@dataclass(frozen=True)
class SilenceProfile:
    """Which gaps are cut and which protected. gap_level: each gap for itself, not the clip as a whole; cap: how
    much of a protected gap stays (None: all). Fixed values: two presets."""

    gap_level: bool = False
    widest: int = 400
    pad: int = 150
    least: int = 300
    keep_unknown: bool = True
    keep_action: bool = True
    keep_edges: bool = True
    keep_speaker_change: bool = True
    cap: int | None = None


CONSERVATIVE = SilenceProfile()
AGGRESSIVE = SilenceProfile(True, 300, 120, 300, False, False, False, True, 1000)


def silence_profile(name: str | None) -> SilenceProfile:
    """A preset by name; the conservative one for an unknown name or none."""
    return {"aggressive": AGGRESSIVE}.get((name or "").strip().lower(), CONSERVATIVE)


NARRATION = "[내레이션]"
#: Words of a description that mark a visual beat.
ACTIONS = (
    "시선", "눈빛", "마주본", "마주친", "키스", "포옹", "안는다", "껴안", "표정", "굳", "찡그", "씁쓸", "충돌", "부딪",
    "주먹", "휘두", "때린", "뺨", "달려든", "달려가", "뛰어", "쓰러", "넘어", "흘리", "눈물", "잡아", "끌어",
)


def narrates(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith(NARRATION), F.lit(False))


def gap_is_safe(known: Column, essential: Column, description: Column, before: Column, after: Column, profile: SilenceProfile = CONSERVATIVE) -> Column:
    """Whether the silence between two texts (null: a clip's edge) may be cut; the first rule that fits decides."""
    rule = F.when(~known, F.lit(not profile.keep_unknown)).when(F.coalesce(essential, F.lit(False)), F.lit(False))
    if profile.keep_action:
        rule = rule.when(F.coalesce(description.rlike("|".join(ACTIONS)), F.lit(False)), F.lit(False))
    rule = rule.when(before.isNull() & after.isNull(), F.lit(True)).when(before.isNull() | after.isNull(), F.lit(not profile.keep_edges))
    if profile.keep_speaker_change:
        rule = rule.when(narrates(before) != narrates(after), F.lit(False))
    return rule.otherwise(F.lit(True))


def with_candidates(clips: DataFrame, found: DataFrame) -> DataFrame:
    """clips with known, essential and description of their candidate; found: lookup()'s rows, one a (chunk, candidate)."""
    own = found.select("chunk_index", "candidate_index", F.lit(True).alias("known"), F.col("visual_essential").alias("essential"), "description")
    return clips.join(own, ["chunk_index", "candidate_index"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def cut_clips(clips: DataFrame, segments: DataFrame, by: Sequence[str], key: str, profile: SilenceProfile = CONSERVATIVE) -> DataFrame:
    """Silence cut aware of the story: pieces (by, key, piece, start_ms, end_ms) of each clip, by the profile's level.

    A clip that is visual_essential itself, or has no speech, stays whole. At clip level one wide gap that is not safe
    keeps the whole clip, else every gap beyond the pads goes. At gap level safe wide gaps go, protected ones stay, or
    keep half the cap on either side; a gap is measured from the farthest end so far, and no piece starts before the
    last one's end. Short pieces join the one before. clips: known, essential, description, visual_essential besides times."""
    s = segments.select(*by, "seg_idx", "text", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = overlap_join(clips.where(~F.coalesce("visual_essential", F.lit(False))), s, by)
    pieces = (_gap_level if profile.gap_level else _clip_level)(met, [*by, key], profile)
    cut = absorb_short(pieces.where("end_ms > start_ms"), [*by, key], profile.least)
    whole = clips.join(cut.select(*by, key).distinct(), [*by, key], "left_anti")
    return cut.unionByName(whole.select(*by, key, F.lit(1).cast("long").alias("piece"), "start_ms", "end_ms"))


def _padded(profile: SilenceProfile) -> tuple[Column, Column]:
    return F.greatest("start_ms", F.col("r_start") - profile.pad), F.least("end_ms", F.col("r_end") + profile.pad)


def _clip_level(met: DataFrame, keys: list[str], profile: SilenceProfile) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("r_start", "seg_idx")
    safe = gap_is_safe(F.col("known"), F.col("essential"), F.col("description"), F.col("text"), F.lead("text").over(order), profile)
    wide = F.lead("r_start").over(order) - F.col("r_end") >= profile.widest
    held = met.withColumn("_held", F.coalesce(wide & ~safe, F.lit(False))).groupBy(*keys).agg(F.bool_or("_held").alias("held"))
    a, z = _padded(profile)
    padded = met.join(held.where("not held"), keys).select(*keys, a.alias("a"), z.alias("z"))
    return union(padded, keys, "a", "z").select(*keys, F.col("a").alias("start_ms"), F.col("z").alias("end_ms"))


def _gap_level(met: DataFrame, keys: list[str], profile: SilenceProfile) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("r_start", "seg_idx")
    so_far = F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("r_start") - F.col("_far")
    safe = gap_is_safe(F.col("known"), F.col("essential"), F.col("description"), F.lag("text").over(order), F.col("text"), profile)
    a, z = _padded(profile)
    rows = met.withColumns({"_far": so_far, "_a": a, "_z": z, "_safe": safe})
    rows = rows.withColumn("_cut", F.coalesce((gap >= profile.widest) & F.col("_safe"), F.lit(False)))
    capped = F.lit(False) if profile.cap is None else F.coalesce(~F.col("_cut") & (gap > profile.cap), F.lit(False))
    rows = rows.withColumn("_capped", capped)
    half = (profile.cap or 0) // 2
    rows = rows.withColumn("_piece", F.sum(F.when(F.col("_cut") | F.col("_capped"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(F.struct("_a", "_far", "_capped", "r_start", "start_ms", "end_ms"), F.struct("r_start", "seg_idx")).alias("first")
    islands = rows.groupBy(*keys, "_piece").agg(first, F.max("_z").alias("_end"))
    at = Window.partitionBy(*keys).orderBy("_piece")
    # How far a capped gap leaves the piece before it, and what it leaves of itself.
    ahead = F.lead("first").over(at)
    reach = F.when(F.coalesce(ahead["_capped"], F.lit(False)), F.greatest("_end", F.least(ahead["end_ms"], ahead["_far"] + half))).otherwise(F.col("_end"))
    own = F.when(F.col("first._capped"), F.least(F.col("first._a"), F.greatest(F.col("first.start_ms"), F.col("first.r_start") - half))).otherwise(F.col("first._a"))
    closed = islands.withColumns({"_reach": reach, "_own": own})
    return closed.select(*keys, F.greatest("_own", F.coalesce(F.lag("_reach").over(at), F.col("_own"))).alias("start_ms"), F.col("_reach").alias("end_ms"))


def removed(clips: DataFrame, pieces: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """How much of each clip its pieces leave out, at least 0."""
    kept = pieces.groupBy(*by, key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_kept"))
    return clips.join(kept, [*by, key], "left").select(*by, key, F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms") - F.coalesce("_kept", F.lit(0))).alias("removed_ms"))


def rollback(original: DataFrame, cut: DataFrame, by: Sequence[str], least: int, most: int) -> DataFrame:
    """A group's original rows if its cut total is under `least` and its original total fits `most`, else the cut ones."""
    total = lambda df, n: df.groupBy(*by).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(n))
    back = total(original, "_o").join(total(cut, "_c"), list(by)).where((F.col("_c") < least) & (F.col("_o") <= most)).select(*by)
    return original.join(back, list(by), "left_semi").unionByName(cut.join(back, list(by), "left_anti"))


def snap_edges(clips: DataFrame, segments: DataFrame, by: Sequence[str], order: str, lead: int = 200, tail: int = 300, far: int = 5000, near: int = 1000, still: int = 50) -> DataFrame:
    """The first clip's start goes to the nearest sentence start (less `lead`) from `far` before to `near`
    after it; the last one's end to the latest sentence end (plus `tail`) from `near` before to `far` after."""
    w = Window.partitionBy(*by)
    marked = clips.withColumns({"_first": F.col(order) == F.min(order).over(w), "_last": F.col(order) == F.max(order).over(w)})
    near_to = lambda rows, points, at, before, after: overlap_join(
        rows.withColumns({"_from": F.col(at) - before, "_to": F.col(at) + after + 1}), points.select(*by, "t", F.col("t").alias("_p"), (F.col("t") + 1).alias("_q")), by, far + near, "inner", "_from", "_to", "_p", "_q"
    )
    heads = near_to(marked.where("_first").select(*by, "start_ms"), segments.select(*by, (F.col("start_ms") - lead).alias("t")), "start_ms", far, near)
    heads = heads.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("t") - F.col("start_ms")), "t"))["t"].alias("_head"))
    tails = near_to(marked.where("_last").select(*by, "end_ms"), segments.select(*by, (F.col("end_ms") + tail).alias("t")), "end_ms", near, far)
    tails = tails.groupBy(*by).agg(F.max("t").alias("_tail"))
    joined = marked.join(heads, list(by), "left").join(tails, list(by), "left")
    start = F.greatest(F.lit(0), F.coalesce("_head", "start_ms"))
    moves = lambda flag, new, old: F.when(F.col(flag) & (F.abs(new - F.col(old)) > still), new).otherwise(F.col(old))
    out = joined.withColumns({"start_ms": moves("_first", start, "start_ms"), "end_ms": moves("_last", F.coalesce("_tail", "end_ms"), "end_ms")})
    return out.drop("_first", "_last", "_head", "_tail")


def extend_edges(clips: DataFrame, by: Sequence[str], order: str, most: int, side: int = 8000, least: int = 500) -> DataFrame:
    """Ends grow into their candidates' context (ext_start, ext_end) while the group stays within `most`: the
    first clip's start by up to `side`, then the last one's end with what is left, each only if it gains over `least`."""
    w = Window.partitionBy(*by)
    budget = F.greatest(F.lit(0), most - F.sum(F.col("end_ms") - F.col("start_ms")).over(w))
    marked = clips.withColumns({"_budget": budget, "_first": F.col(order) == F.min(order).over(w), "_last": F.col(order) == F.max(order).over(w)})
    room = F.col("start_ms") - F.greatest(F.lit(0), F.coalesce("ext_start", "start_ms"))
    gain = F.least("_budget", F.lit(side), room)
    marked = marked.withColumn("_head", F.when(F.col("_first") & (gain > least), gain).otherwise(0))
    left = F.col("_budget") - F.sum("_head").over(w)
    gain = F.least(left, F.lit(side), F.coalesce("ext_end", "end_ms") - F.col("end_ms"))
    marked = marked.withColumn("_tail", F.when(F.col("_last") & (gain > least), gain).otherwise(0))
    return marked.withColumns({"start_ms": F.col("start_ms") - F.col("_head"), "end_ms": F.col("end_ms") + F.col("_tail")}).drop("_budget", "_first", "_last", "_head", "_tail")


def timeline_reason(hook: Column, payoff: Column, build: Column, most: float = 0.3, slack: int = 500) -> Column:
    """ok, or what is wrong with a storyline's order in time."""
    both = overlap(hook["start_ms"], hook["end_ms"], payoff["start_ms"], payoff["end_ms"])
    whole = hook["end_ms"] - hook["start_ms"] + payoff["end_ms"] - payoff["start_ms"] - both
    low, high = F.array_min(F.transform(build, lambda b: b["start_ms"])), F.array_max(F.transform(build, lambda b: b["end_ms"]))
    forward = (hook["start_ms"] - slack <= low) & (high <= payoff["end_ms"] + slack) & (hook["end_ms"] <= payoff["start_ms"] + slack)
    result_first = (high <= payoff["start_ms"] + slack) & (payoff["end_ms"] <= hook["start_ms"] + slack)
    return (
        F.when(hook.isNull() | payoff.isNull(), "ok").when((hook["end_ms"] <= hook["start_ms"]) | (payoff["end_ms"] <= payoff["start_ms"]), "no length")
        .when(both > most * whole, "same scene").when((F.size(build) > 0) & ~(forward | result_first), "out of order").otherwise("ok")
    )


def length_reason(total: Column, count: Column, least: int, most: int, fewest: Column) -> Column:
    """ok, or what is wrong with a storyline's clips: none, too few of them, or a total that is too short or too long."""
    return (
        F.when(F.coalesce(count, F.lit(0)) == 0, "no clips").when(count < fewest, "too few")
        .when(total < least, "too short").when(total > most, "too long").otherwise("ok")
    )


def place_cues(cues: DataFrame, clips: DataFrame, by: Sequence[str], cue: str, total: str = "total", tail: int = 500, least: int = 300) -> DataFrame:
    """Cues (source_ms, dur_ms, chunk_index, candidate_index) on the edit axis: in the piece that holds their
    time (one of the same candidate first), else at the next piece of their candidate, else near the end of
    its last one; others go, as does what is too short. clips: clip_idx, c_chunk, c_cand, times, edit_start."""
    t = F.col("source_ms")
    own = (F.col("chunk_index") == F.col("c_chunk")) & (F.col("candidate_index") == F.col("c_cand"))
    points = cues.withColumns({"_p": t, "_q": t + 1})
    holding = overlap_join(points, clips, by, HOUR, "inner", "_p", "_q", "start_ms", "end_ms").where((F.col("start_ms") <= t) & (t < F.col("end_ms")))
    same = points.join(clips.withColumns({"chunk_index": F.col("c_chunk"), "candidate_index": F.col("c_cand")}), [*by, "chunk_index", "candidate_index"])
    joined = holding.unionByName(same.select(*holding.columns))
    inside = (F.col("start_ms") <= t) & (t < F.col("end_ms"))
    tier = F.when(inside & own, 1).when(inside, 2).when(own & (F.col("start_ms") >= t), 3).when(own, 4)
    tie = F.when(F.col("_tier") <= 2, F.col("clip_idx")).when(F.col("_tier") == 3, F.col("start_ms")).otherwise(-F.col("end_ms"))
    ranked = joined.withColumn("_tier", tier).where("_tier is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*by, cue).orderBy("_tier", tie, "clip_idx"))).where("_n = 1")
    at = F.when(F.col("_tier") <= 2, t).when(F.col("_tier") == 3, F.col("start_ms")).otherwise(F.greatest("start_ms", F.col("end_ms") - tail))
    start = F.col("edit_start") + at - F.col("start_ms")
    placed = ranked.select(*by, cue, total, start.alias("start_ms"), F.least(start + F.col("dur_ms"), F.col(total)).alias("end_ms"))
    return placed.where(F.col("end_ms") - F.col("start_ms") >= least)


def place_subtitles(subs: DataFrame, clips: DataFrame, by: Sequence[str], sub: str, slop: int = 500, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(placed, orphans): subtitles (source_ms, dur_ms) in the clip that holds their time, else in the nearest
    one up to `slop` away; orphans have none, or keep under `least`."""
    w = Window.partitionBy(*by)
    spans = edit_axis(clips, by, ["clip_idx"]).withColumn("_total", F.sum(F.col("end_ms") - F.col("start_ms")).over(w))
    t = F.col("source_ms")
    near = subs.withColumns({"_from": t - slop, "_to": t + slop + 1})
    joined = overlap_join(near, spans.select(*by, "clip_idx", "start_ms", "end_ms", "edit_start", "_total", (F.col("end_ms") + 1).alias("_end")), by, HOUR, "inner", "_from", "_to", "start_ms", "_end")
    inside = (F.col("start_ms") <= t) & (t < F.col("end_ms"))
    away = F.least(F.abs(t - F.col("start_ms")), F.abs(t - F.col("end_ms")))
    near = (t >= F.col("start_ms") - slop) & (t <= F.col("end_ms") + slop)
    order = Window.partitionBy(*by, sub).orderBy(F.when(inside, -1).otherwise(away), "clip_idx")
    best = joined.where(inside | near).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    start = F.col("edit_start") + F.least(F.greatest(t - F.col("start_ms"), F.lit(0)), F.col("end_ms") - F.col("start_ms"))
    placed = best.select(*by, sub, start.alias("edit_s"), F.least(start + F.col("dur_ms"), F.col("_total")).alias("edit_e")).where(F.col("edit_e") - F.col("edit_s") >= least)
    return placed, subs.join(placed.select(*by, sub), [*by, sub], "left_anti")


def place_images(images: DataFrame, clips: DataFrame, by: Sequence[str], image: str, slop: int = 500, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(placed, orphans): images or texts (source_ms, dur_ms and more) on the edit axis by the rules of subtitles; their own
    columns stay, and so does their order, which is their stacking."""
    placed, orphans = place_subtitles(images, clips, by, image, slop, least)
    return images.drop("source_ms", "dur_ms").join(placed, [*by, image]), orphans


def subtitled(clips: DataFrame, segments: DataFrame, by: Sequence[str], order: str = "seg_idx", least: int = 50) -> DataFrame:
    """(by, clip_idx, order, start_ms, end_ms, text) on the edit axis: of clips that keep their sound what is said in them, parts of
    `least` at least; of muted ones their own subtitle (order null), if it is not blank, for all of the clip. Clips of no length give none.

    clips: by, clip_idx, start_ms, end_ms, use_original_audio, subtitle."""
    axis = edit_axis(clips.where("end_ms > start_ms"), by, ["clip_idx"])
    heard = axis.where("use_original_audio").select(*by, "clip_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "edit_start")
    said = remap(segments.select(*by, order, "start_ms", "end_ms", "text"), heard, by, least)
    said = said.select(*by, "clip_idx", order, F.col("edit_s").alias("start_ms"), F.col("edit_e").alias("end_ms"), F.trim("text").alias("text"))
    muted = axis.where("not use_original_audio and trim(subtitle) <> ''")
    own = muted.select(*by, "clip_idx", F.lit(None).cast(segments.schema[order].dataType).alias(order), F.col("edit_start").alias("start_ms"), (F.col("edit_start") + F.col("end_ms") - F.col("start_ms")).alias("end_ms"), F.trim("subtitle").alias("text"))
    return said.unionByName(own)


def uncertain_on_axis(rows: DataFrame, doubtful: DataFrame, clips: DataFrame, by: Sequence[str], key: str, least: int = 50) -> DataFrame:
    """rows on the edit axis with `uncertain`: whether a doubtful span of the source (by, r_start, r_end), seen through the clips, covers `least` of one."""
    axis = edit_axis(clips.where("end_ms > start_ms"), by, ["clip_idx"]).select(*by, "clip_idx", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "edit_start")
    spans = doubtful.select(*by, F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms"))
    seen = remap(spans, axis, by, least).select(*by, F.col("edit_s").alias("r_start"), F.col("edit_e").alias("r_end"))
    return flag_uncertain(rows, seen, by, key, least)


def flag_uncertain(rows: DataFrame, doubtful: DataFrame, by: Sequence[str], key: str, least: int = 50) -> DataFrame:
    """rows with `uncertain`: whether a doubtful span covers `least` of it."""
    met = overlap_join(rows, doubtful, by).where(overlap(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")) >= least)
    return rows.join(met.select(*by, key, F.lit(True).alias("uncertain")).distinct(), [*by, key], "left").withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))


def remap_index(cues: DataFrame, mapping: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Cues with the new index of their clip; those of dropped clips go, those without an index stay."""
    moved = cues.where(F.col(index).isNotNull()).join(mapping.select(*by, F.col("old_idx").alias(index), F.col("new_idx").alias("_new")), [*by, index])
    moved = moved.withColumn(index, F.col("_new").cast(cues.schema[index].dataType)).drop("_new")
    return moved.select(*cues.columns).unionByName(cues.where(F.col(index).isNull()))


def crop_curve(frames: DataFrame, by: Sequence[str], at: str, value: str, most: int = 80) -> DataFrame:
    """Knots of a piecewise linear curve, at most about `most`: (by, t0, t1, v0, slope a second)."""
    w = Window.partitionBy(*by).orderBy(at)
    n = F.count("*").over(Window.partitionBy(*by))
    step = F.when(n > most, F.floor(n / most) + 1).otherwise(1)
    thin = frames.withColumns({"_i": F.row_number().over(w) - 1, "_n": n, "_step": step}).where("_i % _step = 0 or _i = _n - 1")
    ends = thin.withColumns({"t1": F.lead(at).over(w), "v1": F.lead(value).over(w)})
    slope = F.coalesce((F.col("v1") - F.col(value)) / F.greatest(F.col("t1") - F.col(at), F.lit(1)) * 1000, F.lit(0.0))
    return ends.select(*by, F.col(at).alias("t0"), "t1", F.col(value).alias("v0"), slope.alias("slope"))


def nearest_sample(clips: DataFrame, samples: DataFrame, by: Sequence[str], key: str, at: str, most: int = 3000) -> DataFrame:
    """The sample (t, x, y) of a clip's character nearest to a time, up to `most` away."""
    cell = lambda c: F.floor(c / most)
    a = clips.withColumn("_cell", F.explode(F.array(*(cell(F.col(at)) + d for d in (-1, 0, 1)))))
    met = a.join(samples.withColumn("_cell", cell(F.col("t"))), [*by, "_cell"]).where(F.abs(F.col("t") - F.col(at)) <= most)
    best = met.groupBy(*by, key).agg(F.min(F.struct(F.abs(F.col("t") - F.col(at)).alias("d"), "t", "x", "y")).alias("s"))
    return clips.join(best.select(*by, key, "s.t", "s.x", "s.y"), [*by, key], "left")


def find_in_index(asks: DataFrame, appearances: DataFrame, by: Sequence[str], key: str, width: int, height: int, beside: int = 1000, most: int = 3000) -> DataFrame:
    """asks (by, key, character, at_ms) with x and y, the place in a frame of the character's nearest sample, at most `most` away, of an
    appearance that lasts at the time or ends or begins `beside` from it; the first of equally near ones. Null where there is none.

    appearances: by, appearance_idx, character, start_ms, end_ms, samples (an array of structs t_ms, x and y, shares of the frame)."""
    cell = lambda c: F.floor(c / most)
    shown = appearances.select(*by, "character", "appearance_idx", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.posexplode("samples").alias("_i", "_p"))
    shown = shown.withColumn("_cell", cell(F.col("_p.t_ms")))
    dealt = asks.select(*by, key, "character", "at_ms", F.explode(F.array(*(cell(F.col("at_ms")) + d for d in (-1, 0, 1)))).alias("_cell"))
    away = F.abs(F.col("_p.t_ms") - F.col("at_ms"))
    met = dealt.join(shown, [*by, "character", "_cell"]).where((away <= most) & F.col("at_ms").between(F.col("_s") - beside, F.col("_e") + beside))
    best = met.groupBy(*by, key).agg(F.min(F.struct(away.alias("away"), F.col("appearance_idx").alias("a"), F.col("_i").alias("i"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))).alias("_b"))
    return asks.join(best, [*by, key], "left").withColumns({"x": F.col("_b.x") * width, "y": F.col("_b.y") * height}).drop("_b")
