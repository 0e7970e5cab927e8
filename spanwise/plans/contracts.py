"""Queries of override documents, anchored cues and the acceptance of storylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors, clips, contract, ranking
from .catalogue import BY, LONG, query
from .edits import SPEECH_CLIPS, _speech_clips
from .views import CANDIDATES, SEGMENTS, candidates, segments, table

# One document an event, most of whose parts keep the contract: what is odd follows from the event's number and value.

PARTS = """parts as (
  select event_id as n, event_type as kind, cast(floor(value) as bigint) as v,
    case when event_id % 11 = 0 then 'edit_overrides/v9' when event_id % 11 < 3 then 'edit_overrides/v2' when event_id % 11 = 3 then 'edit_overrides/v1' else 'edit_overrides/v3' end as stamp,
    event_id % 5 = 0 as segmented, event_id % 7 <> 6 as clipped, event_id % 3 = 0 as lined, event_id % 2 = 1 as told, event_id % 10 = 1 as pictured, event_id % 10 = 2 as lettered from events)"""

FIRST = f"""with {PARTS} select n as event_id, case
  when stamp = 'edit_overrides/v9' then 'document: schema is unknown'
  when n % 13 = 0 then 'title: top_title is blank'
  when segmented and stamp <> 'edit_overrides/v3' then 'title.segments: needs the newest schema'
  when segmented and n % 9 = 1 then 'title.segments[0]: has an unknown key'
  when segmented and n % 3 = 0 then 'title.segments[1]: times are turned'
  when segmented and n % 8 = 7 then 'title.segments: rows overlap'
  when clipped and n % 17 = 0 then 'clips[0]: start_sec is out of range'
  when clipped and v % 40 < 1 then 'clips[0]: times are turned'
  when clipped and n % 19 = 0 then 'clips[1]: role is unknown'
  when lined and n % 23 = 0 then 'subtitles[0]: text is blank'
  when lined and n % 2 = 0 and stamp <> 'edit_overrides/v3' then 'subtitles[0]: anchor and style need the newest schema'
  when lined and n % 2 = 0 and n % 37 = 0 then 'subtitles[0]: source_time_sec is out of range'
  when lined and n % 2 = 0 and v % 29 < 1 then 'subtitles[0].style: size is not above 0'
  when lined and n % 2 = 0 and v % 120 > 100 then 'subtitles[0].style: y is out of range'
  when lined and n % 2 = 0 and n % 31 = 0 then 'subtitles[0].style: color is no #RRGGBB'
  when lined and n % 2 = 0 and abs(n % 500 - 250) > 180 then 'subtitles[0].style: rotate is out of range'
  when told and n % 41 = 0 then 'tts[0]: source_time_sec is out of range'
  when told and n % 43 = 0 then 'tts[0]: text is blank'
  when told and n % 47 = 0 then 'tts[0]: duration_sec is not above 0'
  when pictured and stamp <> 'edit_overrides/v3' then 'images: needs the newest schema'
  when pictured and n % 4 = 1 and v % 3 = 0 then 'images[0]: file leaves the folder'
  when pictured and v % 5 = 0 then 'images[0]: file is no png or jpg'
  when pictured and v % 110 > 100 then 'images[0]: x is out of range'
  when pictured and n % 9 = 0 then 'images[0]: layer is no integer'
  when lettered and stamp <> 'edit_overrides/v3' then 'texts: needs the newest schema'
  when lettered and v % 70 = 0 then 'texts[0]: text is blank'
  when lettered and v % 70 > 60 then 'texts[0]: text is over 60 letters'
  when lettered and n % 410 not between 12 and 400 then 'texts[0]: size is out of range'
  when lettered and kind = 'error' then 'texts[0]: stroke is unknown'
  else 'ok' end as reason from parts"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v, kind = F.col("event_id"), F.floor("value").cast(LONG), F.col("event_type")
    struct = lambda **more: F.struct(*(c.alias(k) for k, c in more.items()))
    lit, left = F.lit, n % 11
    stamp = F.when(left == 0, "edit_overrides/v9").when(left < 3, "edit_overrides/v2").when(left == 3, "edit_overrides/v1").otherwise("edit_overrides/v3")
    segments_ = F.array(
        struct(text=lit("one"), start_sec=lit(0), end_sec=F.when(n % 8 == 7, 6).otherwise(4), size=F.when(n % 9 == 1, 3)),
        struct(text=lit("two"), start_sec=lit(5), end_sec=5 + n % 3, size=lit(None).cast("int")),
    )
    start = n % 17 - 1
    clips_ = F.array(struct(start_sec=start, end_sec=start + v % 40, role=lit("hook")), struct(start_sec=lit(1), end_sec=lit(2), role=F.when(n % 19 == 0, "intro").otherwise("payoff")))
    colour = F.when(n % 31 == 0, "#12345").otherwise("#12Ab3F")
    style = F.when(n % 2 == 0, struct(size=v % 29, y=v % 120 / 100, color=colour, rotate=n % 500 - 250))
    lines = F.array(struct(start_sec=lit(0), end_sec=lit(1.5), text=F.when(n % 23 == 0, " ").otherwise(kind), style=style, source_time_sec=F.when(n % 2 == 0, n % 37 - 1).cast(LONG)))
    lines = F.transform(lines, lambda r: r.withField("source_time_sec", F.when(n % 37 == 0, r["source_time_sec"]).otherwise(F.abs(r["source_time_sec"]))))
    told = F.array(struct(source_time_sec=n % 41 - F.when(n % 41 == 0, 1).otherwise(0), text=F.when(n % 43 == 0, "\t").otherwise("said"), duration_sec=(n % 47).cast("string")))
    file = F.when((n % 4 == 1) & (v % 3 == 0), "../up.png").when(v % 5 == 0, "a/b.gif").otherwise("a/b.JPG")
    pictures = F.array(struct(file=file, source_time_sec=n, duration_sec=lit(2), x=v % 110 / 100, y=lit(0), w=lit(1), layer=F.when(n % 9 == 0, 0.5).otherwise(1).cast("decimal(3,1)").cast("string")))
    stroke = F.when(kind == "error", "red").otherwise("white")
    letters = F.array(struct(text=F.repeat(lit("x"), (v % 70).cast("int")), source_time_sec=n, duration_sec=lit(2), x=lit(0.5), y=lit(0.25), size=n % 410, stroke=stroke))
    document = F.to_json(struct(
        schema=stamp, title=struct(top_title=F.when(n % 13 == 0, " ").otherwise("name"), segments=F.when(n % 5 == 0, segments_)), clips=F.when(n % 7 != 6, clips_), subtitles=F.when(n % 3 == 0, lines),
        tts=F.when(n % 2 == 1, told), images=F.when(n % 10 == 1, pictures), texts=F.when(n % 10 == 2, letters),
    ))
    # A layer is written as a bare number: 1, or the fraction 0.5.
    document = F.regexp_replace(document, r'"layer":"(\d)\.(\d)"', '"layer":$1.$2')
    document = F.regexp_replace(document, r'"layer":1\.0', '"layer":1')
    return table(spark, sf_dir, "events").select("event_id", document.alias("document"))


@query(FIRST)
def override_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.first_violation(_documents(spark, sf_dir), "event_id")


# One document a conversation: its speech clips, moved by 700 ms, over its segments as the old clips.

OLD = f"""{SPEECH_CLIPS}, olds as (select source_id, cast(seg_idx as bigint) as old, start_ms, end_ms, text as subtitle, seg_idx % 2 = 0 as audio, case when seg_idx % 3 = 0 then 'n' || seg_idx else '' end as note, seg_idx // 4 as chunk, seg_idx % 4 as cand from segments),
news as (select source_id, clip_idx, start_ms + 700 as start_ms, end_ms + 700 as end_ms from clips where end_ms > start_ms),
docs as (select distinct source_id from news)"""


def _old_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_idx")
    return segments(spark, sf_dir).select(
        "source_id", i.cast(LONG).alias("clip_idx"), "start_ms", "end_ms", F.col("text").alias("subtitle"), (i % 2 == 0).alias("use_original_audio"), F.when(i % 3 == 0, F.concat(F.lit("n"), i)).otherwise("").alias("pacing_note"),
        F.floor(i / 4).cast(LONG).alias("chunk_index"), (i % 4).cast(LONG).alias("candidate_index"),
    )


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("source_id"), F.col("clip_idx")
    sec = lambda c: ((F.col(c) + 700) / 1000).cast("decimal(18,3)")
    clip = F.struct(i, sec("start_ms").alias("start_sec"), sec("end_ms").alias("end_sec"), F.when(i == 0, "hook").alias("role"), F.when(i % 3 == 1, "mine").alias("subtitle"), F.when(i % 2 == 1, False).alias("use_original_audio"))
    cue = F.struct(i, sec("start_ms").alias("source_time_sec"), F.concat(F.lit(" cue "), i).alias("text"), F.when(i % 2 == 0, 1.5).alias("duration_sec"), F.when(i % 3 == 0, "ko_male").alias("voice"))
    text = F.struct(i, F.concat(F.lit("text "), i).alias("text"), sec("start_ms").alias("source_time_sec"), F.lit(2).alias("duration_sec"), F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.when(i % 2 == 0, 20.5 + i).alias("size"), F.when(i % 3 == 0, "#aabbcc").alias("color"))
    rows = _speech_clips(spark, sf_dir).where("end_ms > start_ms").groupBy("source_id").agg(*(F.array_sort(F.collect_list(c)).alias(name) for name, c in (("clips", clip), ("tts", cue), ("texts", text))))
    bare = lambda c: F.transform(c, lambda r: r.dropFields("clip_idx"))
    title = F.struct(F.when(n % 3 == 0, F.concat(F.lit(" title "), n)).alias("top_title"))
    parts = F.struct(F.lit(contract.NEWEST).alias("schema"), title.alias("title"), F.when(n % 4 != 3, bare("clips")).alias("clips"), F.when(n % 2 == 0, bare("tts")).alias("tts"), bare("texts").alias("texts"))
    return rows.select("source_id", F.to_json(parts).alias("document"))


@query(f"""with {OLD}, met as (select n.source_id, n.clip_idx, o.*, row_number() over (partition by n.source_id, n.clip_idx order by least(n.end_ms, o.end_ms) - greatest(n.start_ms, o.start_ms) desc, o.old) as place
    from news n join olds o on n.source_id = o.source_id and n.start_ms < o.end_ms and n.end_ms > o.start_ms)
select n.source_id, n.clip_idx, case when n.clip_idx = 0 then 'hook' else 'build' end as role, n.start_ms, n.end_ms, case when n.clip_idx % 3 = 1 then 'mine' else coalesce(m.subtitle, '') end as subtitle,
  case when n.clip_idx % 2 = 1 then false else coalesce(m.audio, true) end as use_original_audio, coalesce(m.note, '') as pacing_note, cast(coalesce(m.chunk, -1) as bigint) as chunk_index, cast(coalesce(m.cand, -1) as bigint) as candidate_index
from news n left join met m on m.source_id = n.source_id and m.clip_idx = n.clip_idx and m.place = 1 where n.source_id % 4 <> 3""")
def override_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contract.clips(_edited(spark, sf_dir), _old_clips(spark, sf_dir), "source_id")
    return found.withColumn("clip_idx", F.col("clip_idx").cast(LONG))


@query(f"""with {OLD}, variants as (select source_id, v as variant_id, 'old ' || v as title from docs, (select unnest([0, 1, 2]) as v))
select source_id, cast(variant_id as bigint) as variant_id, case when variant_id = 0 and source_id % 3 = 0 then 'title ' || source_id else title end as title, variant_id = 0 and source_id % 4 <> 3 as pinned from variants""")
def override_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _edited(spark, sf_dir)
    olds = docs.select("source_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("variant_id")).withColumn("title", F.concat(F.lit("old "), "variant_id"))
    return contract.variants(olds, docs, "source_id").withColumn("variant_id", F.col("variant_id").cast(LONG))


@query(f"""with {OLD}, had as (select source_id, old, start_ms as at, end_ms - start_ms as dur, case when old % 2 = 0 then 'chat_emma' else '' end as voice, chunk, cand from olds),
asks as (select source_id, row_number() over (partition by source_id order by clip_idx) - 1 as i, clip_idx, start_ms as t from news where source_id % 2 = 0),
met as (select a.source_id, a.clip_idx, h.*, row_number() over (partition by a.source_id, a.clip_idx order by abs(a.t - h.at), h.old desc) as place from asks a join had h on a.source_id = h.source_id and abs(a.t - h.at) <= 1000)
select a.source_id, cast(row_number() over (partition by a.source_id order by t, i) - 1 as bigint) as place, 'cue ' || a.clip_idx as text, t as source_ms, cast(case when a.clip_idx % 2 = 0 then 1500 else coalesce(dur, 3000) end as bigint) as dur_ms,
  case when a.clip_idx % 3 = 0 then 'ko_male' when m.voice <> '' then m.voice else 'ko_female' end as voice, 'normal' as speed, cast(coalesce(m.chunk, -1) as bigint) as chunk_index, cast(coalesce(m.cand, -1) as bigint) as candidate_index
from asks a left join met m on m.source_id = a.source_id and m.clip_idx = a.clip_idx and m.place = 1""")
def override_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _old_clips(spark, sf_dir)
    olds = old.select("source_id", F.col("clip_idx").alias("old_idx"), F.col("start_ms").alias("source_ms"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), F.when(F.col("clip_idx") % 2 == 0, "chat_emma").otherwise("").alias("voice"), F.lit("").alias("speed"), "chunk_index", "candidate_index")
    return contract.cues(_edited(spark, sf_dir), olds, "source_id").withColumn("place", F.col("place").cast(LONG))


@query(f"""with {OLD}, spans as (select *, coalesce(sum(end_ms - start_ms) over (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding), 0) as base, sum(end_ms - start_ms) over (partition by source_id) as total from clips where end_ms > start_ms),
asks as (select source_id, row_number() over (partition by source_id order by clip_idx) - 1 as idx, clip_idx as i, start_ms as t from news),
met as (select a.*, s.start_ms as c0, s.end_ms as c1, s.base, s.total, row_number() over (partition by a.source_id, a.idx order by case when s.start_ms <= t and t < s.end_ms then -1 else least(abs(t - s.start_ms), abs(t - s.end_ms)) end, s.clip_idx) as place
  from asks a join spans s on a.source_id = s.source_id and t between s.start_ms - 500 and s.end_ms + 500),
put as (select *, base + least(greatest(t - c0, 0), c1 - c0) as a from met where place = 1)
select source_id, cast(idx as bigint) as idx, 'text ' || i as text, cast(case when i % 2 = 0 then round_even(20.5 + i, 0) else 72 end as bigint) as size, case when i % 3 = 0 then '#AABBCC' else '#FFFFFF' end as color, 'dark' as stroke, 'Jalnan' as font,
  cast(a as bigint) as edit_s, cast(least(a + 2000, total) as bigint) as edit_e from put where least(a + 2000, total) - a >= 100""")
def override_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = contract.texts(_edited(spark, sf_dir), "source_id")
    placed, _ = clips.place_images(told, _speech_clips(spark, sf_dir).where("end_ms > start_ms"), BY, "idx")
    return placed.select("source_id", F.col("idx").cast(LONG).alias("idx"), "text", F.col("size").cast(LONG).alias("size"), "color", "stroke", "font", "edit_s", "edit_e")


# Cues of every segment: anchored ones by clip and offset, older ones by a time on the edited axis.

CUE_ROWS = f"""{SPEECH_CLIPS}, anchors as (select source_id, clip_idx, start_ms, end_ms, greatest(0, end_ms - start_ms) as len, coalesce(sum(greatest(0, end_ms - start_ms)) over w, 0) as base, clip_idx * 3 as chunk, clip_idx % 2 as cand from clips
  window w as (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding)),
totals as (select source_id, sum(len) as total from anchors group by 1),
raw as (select source_id, seg_idx, case when seg_idx % 7 <> 0 then text end as text, speaker as voice, case when seg_idx % 2 = 0 then 'fast' else 'odd' end as speed, case when seg_idx % 3 <> 0 then cast(seg_idx // 3 as bigint) end as clip_index,
  seg_idx * 700 - 1000 as offset_ms, seg_idx % 5 * 500 as dur_ms, seg_idx * 2000 - 900 as a, seg_idx * 2000 + seg_idx % 4 * 1000 - 1000 as z from segments where seg_idx % 11 <> 10),
old as (select r.source_id, seg_idx, text, voice, speed, greatest(a, 0) as t, z - greatest(a, 0) as dur from raw r join totals using (source_id) where clip_index is null and z > a and a >= -500 and a < total + 500),
traced as (select o.source_id, seg_idx, text, voice, speed, (select max(clip_idx) from anchors x where x.source_id = o.source_id and x.base <= o.t) as clip_index, t, dur from old o),
every as (select r.source_id, seg_idx, text, voice, speed, clip_index, offset_ms, dur_ms as dur from raw r where clip_index is not null
  union all by name select t.source_id, seg_idx, text, voice, speed, t.clip_index, t.t - x.base as offset_ms, dur from traced t join anchors x on t.source_id = x.source_id and t.clip_index = x.clip_idx),
good as (select e.source_id, seg_idx, trim(text) as text, case when voice in ('user', 'assistant') then voice else 'assistant' end as voice, case when speed = 'fast' then speed else 'normal' end as speed, e.clip_index, least(greatest(offset_ms, 0), x.len) as offset_ms, dur as dur_ms, x.start_ms, x.chunk, x.cand
  from every e join anchors x on e.source_id = x.source_id and e.clip_index = x.clip_idx where text is not null and dur > 0),
placed as (select *, row_number() over (partition by source_id order by clip_index, offset_ms, seg_idx) - 1 as place from good),
votes as (select source_id, voice, count(*) as n, min(place) as f from placed group by 1, 2), chosen as (select source_id, arg_max(voice, (n, -f)) as voice from votes group by 1)"""


@query(f"""with {CUE_ROWS} select source_id, cast(seg_idx as bigint) as seg_idx, cast(place as bigint) as place, clip_index, cast(offset_ms as bigint) as offset_ms, cast(dur_ms as bigint) as dur_ms, cast(start_ms + offset_ms as bigint) as source_ms,
  cast(chunk as bigint) as chunk_index, cast(cand as bigint) as candidate_index, text, chosen.voice, speed from placed join chosen using (source_id) where place < 5""")
def cues_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_idx").cast(LONG)
    raw = segments(spark, sf_dir).where("seg_idx % 11 <> 10").select(
        "source_id", i.alias("seg_idx"), F.when(i % 7 != 0, F.col("text")).alias("text"), F.col("speaker").alias("voice"), F.when(i % 2 == 0, "fast").otherwise("odd").alias("speed"),
        F.when(i % 3 != 0, F.floor(i / 3)).cast(LONG).alias("clip_index"), (i * 700 - 1000).alias("offset_ms"), (i % 5 * 500).alias("dur_ms"), (i * 2000 - 900).alias("start_ms"), (i * 2000 + i % 4 * 1000 - 1000).alias("end_ms"),
    )
    known = _speech_clips(spark, sf_dir).withColumns({"chunk_index": F.col("clip_idx") * 3, "candidate_index": F.col("clip_idx") % 2})
    return anchors.anchored(raw, known, BY, "seg_idx", voices=("assistant", "user"), speeds=("normal", "fast")).withColumn("place", F.col("place").cast(LONG))


# Storylines of a source, best first: order in time, length and number of clips decide what is taken.

TAKEN = f"""{CANDIDATES}, told as (select *, end_ms - start_ms as len, row_number() over (partition by source_id order by score desc, cand_idx) as rank from candidates),
parts as (select *, start_ms as h0, start_ms + len // 4 as h1, case when cand_idx % 5 = 0 then start_ms + len // 8 else end_ms - len // 4 end as p0, case when cand_idx % 5 = 0 then start_ms + len // 3 else end_ms end as p1,
  case when cand_idx % 7 = 0 then start_ms - 600000 else start_ms + len // 4 end as b0, case when cand_idx % 7 = 0 then start_ms - 1000 else end_ms - len // 2 end as b1 from told),
judged as (select *, greatest(0, least(h1, p1) - greatest(h0, p0)) as shared, case when cand_idx % 3 = 0 then 1 else 3 end as n, cand_idx % 4 = 0 as highlight from parts),
valid as (select * from judged where h1 > h0 and p1 > p0 and shared <= 0.3::double * (h1 - h0 + p1 - p0 - shared)
  and ((h0 - 500 <= b0 and b1 <= p1 + 500 and h1 <= p0 + 500) or (b1 <= p0 + 500 and p1 <= h0 + 500)) and len between 600000 and 120000000 and n >= case when highlight then 1 else 2 end),
able as (select * from valid v where score >= 400 or rank = (select min(rank) from valid w where w.source_id = v.source_id))"""


@query(f"with {TAKEN}, put as (select source_id, cand_idx, cast(row_number() over (partition by source_id order by rank) as bigint) as place from able) select * from put where place <= 3")
def storylines_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ranking.top(candidates(spark, sf_dir), BY, [F.col("score").desc(), F.col("cand_idx")], 1 << 30, "rank")
    n, start, end, length = F.col("cand_idx"), F.col("start_ms"), F.col("end_ms"), F.col("end_ms") - F.col("start_ms")
    whole = lambda by: F.floor(length / by)
    span = lambda a, z: F.struct(a.alias("start_ms"), z.alias("end_ms"))
    close = n % 5 == 0
    payoff = span(F.when(close, start + whole(8)).otherwise(end - whole(4)), F.when(close, start + whole(3)).otherwise(end))
    build = span(F.when(n % 7 == 0, start - 600_000).otherwise(start + whole(4)), F.when(n % 7 == 0, start - 1000).otherwise(end - whole(2)))
    ordered = clips.timeline_reason(span(start, start + whole(4)), payoff, F.array(build)) == "ok"
    gate = clips.length_reason(length, F.when(n % 3 == 0, 1).otherwise(3), 600_000, 120_000_000, F.when(n % 4 == 0, 1).otherwise(2)) == "ok"
    taken = ranking.accept(told, BY, "rank", "score", ordered & gate, 3, 400)
    return taken.select("source_id", "cand_idx", F.col("place").cast(LONG).alias("place"))
