"""Queries of the clip, document and transcript operators, each with the SQL that must agree with it.

A clip is an event's span; its candidate key is made of the event's number, its storyline is its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transcripts
from ..operators import checks, clips, documents, quotes, ranking
from .catalogue import BY, LONG, MARKS, query
from .views import CANDIDATES, SEGMENTS, candidates, segments, table

DAY = 86_400_000

KEYED = f"""{CANDIDATES}, keyed as (
  select *, cast(cand_idx % 40 - 1 as bigint) as chunk_index, cast(cand_idx % 25 - 1 as bigint) as candidate_index from candidates)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lambda n: (F.col("cand_idx") % n - 1).cast(LONG)
    return candidates(spark, sf_dir).withColumns({"chunk_index": index(40), "candidate_index": index(25)})


LOOKUP = f"""{KEYED}, lookup as (select * exclude (rn) from (
  select *, row_number() over (partition by chunk_index, candidate_index order by cand_idx desc) as rn from keyed where chunk_index >= 0 and candidate_index >= 0) where rn = 1)"""


@query(f"with {LOOKUP} select chunk_index, candidate_index, cand_idx, start_ms, end_ms from lookup")
def clip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.lookup(_keyed(spark, sf_dir), "cand_idx").select("chunk_index", "candidate_index", "cand_idx", "start_ms", "end_ms")


@query(f"""with {LOOKUP} select k.cand_idx, coalesce(l.start_ms, k.start_ms) as start_ms, coalesce(l.end_ms, k.end_ms) as end_ms, coalesce(l.kind, k.kind) as description
from keyed k left join lookup l on k.chunk_index = l.chunk_index and k.candidate_index = l.candidate_index""")
def clip_restore_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir).withColumnRenamed("kind", "description")
    return clips.restore_times(keyed, clips.lookup(keyed, "cand_idx")).select("cand_idx", "start_ms", "end_ms", "description")


@query(f"with {CANDIDATES} select source_id, cand_idx from candidates where kind <> 'view'")
def clip_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = candidates(spark, sf_dir).withColumn("flags", F.array(F.when(F.col("kind") == "view", "spoiler").otherwise(" ")))
    return clips.filter_flagged(flagged)[0].select("source_id", "cand_idx")


@query(f"""with {CANDIDATES}, z as (select *, min(start_ms) over (partition by source_id) + 86400000 as intro, max(start_ms) over (partition by source_id) - 86400000 as credits from candidates)
select source_id, cand_idx from z where (start_ms + end_ms) / 2.0 >= intro and (start_ms + end_ms) / 2.0 < credits""")
def clip_outside_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source_id")
    zoned = candidates(spark, sf_dir).withColumns({"intro": F.min("start_ms").over(w) + DAY, "credits": F.max("start_ms").over(w) - DAY})
    return clips.outside_zones(zoned, F.col("intro"), F.col("credits")).select("source_id", "cand_idx")


@query(f"with {CANDIDATES} select source_id, cand_idx, cast(floor(start_ms / 1.25::double + 0.5) as bigint) as start_ms, cast(floor(end_ms / 1.25::double + 0.5) as bigint) as end_ms from candidates")
def clip_at_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.at_speed(candidates(spark, sf_dir).select("source_id", "cand_idx", "start_ms", "end_ms"), 1.25)


@query(f"""with {CANDIDATES}, doubt as (select source_id, start_ms as r_start, start_ms + 3600000 as r_end from candidates where kind = 'error')
select source_id, cand_idx, exists (select 1 from doubt d where d.source_id = c.source_id and c.start_ms < d.r_end and c.end_ms > d.r_start
  and least(c.end_ms, d.r_end) - greatest(c.start_ms, d.r_start) >= 50) as uncertain from candidates c""")
def clip_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("source_id", "cand_idx", "start_ms", "end_ms")
    doubt = candidates(spark, sf_dir).where("kind = 'error'").select("source_id", F.col("start_ms").alias("r_start"), (F.col("start_ms") + 3_600_000).alias("r_end"))
    return clips.flag_uncertain(c, doubt, BY, "cand_idx").select("source_id", "cand_idx", "uncertain")


@query(f"""with {CANDIDATES}, map as (select source_id, cand_idx as old_idx, row_number() over (partition by source_id order by cand_idx) - 1 as new_idx from candidates where kind <> 'error')
select c.source_id, m.new_idx as cand_idx, c.start_ms from candidates c join map m on c.source_id = m.source_id and c.cand_idx = m.old_idx""")
def cue_remap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("source_id", F.col("cand_idx").cast(LONG).alias("cand_idx"), "start_ms", "kind")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("cand_idx")) - 1
    mapping = c.where("kind <> 'error'").select("source_id", F.col("cand_idx").alias("old_idx"), place.alias("new_idx"))
    return clips.remap_index(c.drop("kind"), mapping, BY, "cand_idx")


@query(f"""with {CANDIDATES}, t as (select *, cand_idx % 4 as part, end_ms > start_ms as filled from candidates),
g as (select source_id, min(case when part = 0 then start_ms end) as h0, max(case when part = 0 then end_ms end) as h1,
        min(case when part = 3 then start_ms end) as p0, max(case when part = 3 then end_ms end) as p1,
        min(case when part = 1 then start_ms end) as b0, max(case when part = 1 then end_ms end) as b1 from t where filled group by 1),
o as (select *, case when h1 > h0 and p1 > p0 then greatest(0, least(h1, p1) - greatest(h0, p0)) end as shared from g)
select source_id, case when h0 is null or p0 is null then 'ok' when h1 <= h0 or p1 <= p0 then 'no length' when shared > 0.3::double * (h1 - h0 + p1 - p0 - shared) then 'same scene'
  when b0 is not null and not ((h0 - 500 <= b0 and b1 <= p1 + 500 and h1 <= p0 + 500) or (b1 <= p0 + 500 and p1 <= h0 + 500)) then 'out of order' else 'ok' end as reason from o""")
def story_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where("end_ms > start_ms")
    of = lambda n: [F.min(F.when(F.col("cand_idx") % 4 == n, F.col("start_ms"))).alias(f"s{n}"), F.max(F.when(F.col("cand_idx") % 4 == n, F.col("end_ms"))).alias(f"e{n}")]
    spans = c.groupBy("source_id").agg(*of(0), *of(1), *of(3))
    one = lambda n: F.when(F.col(f"s{n}").isNotNull(), F.struct(F.col(f"s{n}").alias("start_ms"), F.col(f"e{n}").alias("end_ms")))
    told = spans.select("source_id", one(0).alias("hook"), one(3).alias("payoff"), F.filter(F.array(one(1)), lambda b: b.isNotNull()).alias("build"))
    return told.select("source_id", clips.timeline_reason(F.col("hook"), F.col("payoff"), F.col("build")).alias("reason"))


@query(f"""with {CANDIDATES}, e as (select *, row_number() over w = 1 as first, row_number() over (partition by source_id order by cand_idx desc) = 1 as last,
  greatest(0, 14400000000 - sum(end_ms - start_ms) over (partition by source_id)) as budget from candidates window w as (partition by source_id order by cand_idx)),
h as (select *, case when first and least(budget, 8000, 20000) > 500 then least(budget, 8000, 20000) else 0 end as head from e),
t as (select *, budget - sum(head) over (partition by source_id) as room from h)
select source_id, cand_idx, cast(start_ms - head as bigint) as start_ms, cast(end_ms + case when last and least(room, 8000, 3000) > 500 then least(room, 8000, 3000) else 0 end as bigint) as end_ms from t""")
def clip_extend_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"ext_start": F.col("start_ms") - 20_000, "ext_end": F.col("end_ms") + 3000})
    return clips.extend_edges(c, BY, "cand_idx", 14_400_000_000).select("source_id", "cand_idx", "start_ms", "end_ms")


SPEECH_CLIPS = f"""{SEGMENTS}, clips as (select source_id, cast(seg_idx // 4 as bigint) as clip_idx, min(start_ms) + 137 as start_ms, max(end_ms) - 211 as end_ms from segments group by 1, 2)"""


def _speech_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.floor(F.col("seg_idx") / 4).cast(LONG).alias("clip_idx")
    return segments(spark, sf_dir).groupBy("source_id", group).agg((F.min("start_ms") + 137).alias("start_ms"), (F.max("end_ms") - 211).alias("end_ms"))


@query(f"""with {SPEECH_CLIPS}, e as (select *, min(clip_idx) over w = clip_idx as first, max(clip_idx) over w = clip_idx as last from clips window w as (partition by source_id)),
head as (select source_id, arg_min(t, (abs(t - start_ms), t)) as h from (select e.source_id, e.start_ms, s.start_ms - 200 as t from e join segments s using (source_id) where first)
  where t between start_ms - 5000 and start_ms + 1000 group by 1),
tail as (select source_id, max(t) as z from (select e.source_id, e.end_ms, s.end_ms + 300 as t from e join segments s using (source_id) where last) where t between end_ms - 1000 and end_ms + 5000 group by 1)
select source_id, clip_idx, case when first and abs(greatest(0, coalesce(h, start_ms)) - start_ms) > 50 then greatest(0, coalesce(h, start_ms)) else start_ms end as start_ms,
  case when last and abs(coalesce(z, end_ms) - end_ms) > 50 then coalesce(z, end_ms) else end_ms end as end_ms from e left join head using (source_id) left join tail using (source_id)""")
def clip_snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("source_id", "start_ms", "end_ms")
    return clips.snap_edges(_speech_clips(spark, sf_dir), s, BY, "clip_idx").select("source_id", "clip_idx", "start_ms", "end_ms")


SUBS = f"""{SPEECH_CLIPS}, good as (select * from clips where end_ms > start_ms),
spans as (select *, coalesce(sum(end_ms - start_ms) over (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding), 0) as edit_start,
  sum(end_ms - start_ms) over (partition by source_id) as total from good),
met as (select s.source_id, s.seg_idx, s.start_ms as t, s.end_ms - s.start_ms as dur, c.start_ms as c0, c.end_ms as c1, c.edit_start, c.total,
  row_number() over (partition by s.source_id, s.seg_idx order by case when c.start_ms <= s.start_ms and s.start_ms < c.end_ms then -1 else least(abs(s.start_ms - c.start_ms), abs(s.start_ms - c.end_ms)) end, c.clip_idx) as rn
  from segments s join spans c on s.source_id = c.source_id and s.start_ms >= c.start_ms - 500 and s.start_ms <= c.end_ms + 500),
put as (select source_id, seg_idx, edit_start + least(greatest(t - c0, 0), c1 - c0) as edit_s, dur, total from met where rn = 1)"""


@query(f"with {SUBS} select source_id, seg_idx, cast(edit_s as bigint) as edit_s, cast(least(edit_s + dur, total) as bigint) as edit_e from put where least(edit_s + dur, total) - edit_s >= 100")
def subtitle_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = segments(spark, sf_dir).select("source_id", "seg_idx", F.col("start_ms").alias("source_ms"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
    return clips.place_subtitles(subs, _speech_clips(spark, sf_dir).where("end_ms > start_ms"), BY, "seg_idx")[0]


@query(f"""with {CANDIDATES}, near as (select c.source_id, c.cand_idx, s.start_ms as t, row_number() over (partition by c.source_id, c.cand_idx order by abs(s.start_ms - c.end_ms), s.start_ms, s.cand_idx) as rn
  from candidates c join candidates s on c.source_id = s.source_id and s.kind = 'view' and abs(s.start_ms - c.end_ms) <= 7200000)
select c.source_id, c.cand_idx, n.t from candidates c left join near n on c.source_id = n.source_id and c.cand_idx = n.cand_idx and n.rn = 1""")
def clip_nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("source_id", "cand_idx", "start_ms", "end_ms")
    samples = candidates(spark, sf_dir).where("kind = 'view'").select("source_id", F.col("start_ms").alias("t"), F.col("cand_idx").alias("x"), F.lit(0).alias("y"))
    return clips.nearest_sample(c, samples, BY, "cand_idx", "end_ms", 7_200_000).select("source_id", "cand_idx", "t")


@query(f"""with {CANDIDATES}, n as (select *, row_number() over (partition by source_id order by start_ms) - 1 as i, count(*) over (partition by source_id) as n from candidates),
t as (select * from n where i % (case when n > 40 then n // 40 + 1 else 1 end) = 0 or i = n - 1),
k as (select *, lead(start_ms) over (partition by source_id order by start_ms) as t1, lead(score) over (partition by source_id order by start_ms) as v1 from t)
select source_id, start_ms as t0, t1, score as v0, coalesce(cast(floor((v1 - score)::double / greatest(t1 - start_ms, 1) * 1000 * 1000000) as bigint), 0) as slope_micro from k""")
def crop_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.crop_curve(candidates(spark, sf_dir), BY, "start_ms", "score", 40).select("source_id", "t0", "t1", "v0", F.floor(F.col("slope") * 1_000_000).cast(LONG).alias("slope_micro"))


#: Clips of four turns, every fifth a visual beat; turns of the assistant are narrated, and clips of an odd number
#: have a candidate, those of 3, 7, .. with a moving description.
SILENT = f"""{SPEECH_CLIPS}, good as (select *, clip_idx % 5 = 4 as beat, clip_idx % 2 = 1 as known, clip_idx % 4 = 3 as moving from clips where end_ms > start_ms),
said as (select source_id, seg_idx, start_ms as s0, end_ms as s1, speaker = 'assistant' as narrated from segments),
met as (select g.source_id, clip_idx, start_ms as c0, end_ms as c1, known, moving, seg_idx, s0, s1, narrated, lag(narrated) over w as before, lead(narrated) over w as after,
  lag(s1) over w as p1, lead(s0) over w as n0, max(s1) over (partition by g.source_id, clip_idx order by s0, seg_idx rows between unbounded preceding and 1 preceding) as far
  from good g join said using (source_id) where s0 < end_ms and s1 > start_ms and not beat window w as (partition by g.source_id, clip_idx order by s0, seg_idx))"""
ABSORBED = """numbered as (select *, sum(k) over (partition by source_id, clip_idx order by a, z rows between unbounded preceding and current row) as piece from (
  select *, case when row_number() over (partition by source_id, clip_idx order by a, z) = 1 or z - a >= 300 then 1 else 0 end as k from islands where z > a)),
cut as (select source_id, clip_idx, piece, min(a) as start_ms, arg_max(z, (a, z)) as end_ms from numbered group by 1, 2, 3),
pieces as (select * from cut union all select source_id, clip_idx, 1, start_ms, end_ms from good where (source_id, clip_idx) not in (select (source_id, clip_idx) from cut))"""
PIECES_OUT = "select source_id, clip_idx, cast(piece as bigint) as piece, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms from pieces"


def _silent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _speech_clips(spark, sf_dir).where("end_ms > start_ms")
    c = c.withColumns({"visual_essential": F.expr("clip_idx % 5 = 4"), "known": F.expr("clip_idx % 2 = 1"), "essential": F.lit(False), "description": F.when(F.expr("clip_idx % 4 = 3"), "문이 열리고 달려든다").otherwise("복도")})
    s = segments(spark, sf_dir).withColumn("text", F.when(F.col("speaker") == "assistant", F.concat(F.lit(f" {clips.NARRATION}"), "text")).otherwise(F.col("text")))
    return c, s


@query(f"""with {SILENT}, held as (select source_id, clip_idx, bool_or(coalesce(n0 - s1 >= 400 and (not known or moving or narrated <> after), false)) as held from met group by 1, 2),
pad as (select source_id, clip_idx, greatest(c0, s0 - 150) as a, least(c1, s1 + 150) as z from met join held using (source_id, clip_idx) where not held),
fresh as (select *, case when pm is null or a > pm then 1 else 0 end as f from (
  select *, max(z) over (partition by source_id, clip_idx order by a, z rows between unbounded preceding and 1 preceding) as pm from pad where z > a)),
islands as (select source_id, clip_idx, island, min(a) as a, max(z) as z from (
  select *, sum(f) over (partition by source_id, clip_idx order by a, z rows between unbounded preceding and current row) as island from fresh) group by 1, 2, 3), {ABSORBED} {PIECES_OUT}""")
def clip_silence_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.cut_clips(*_silent(spark, sf_dir), BY, "clip_idx", clips.CONSERVATIVE)


GAPS = f"""{SILENT}, decided as (select *, coalesce(s0 - far >= 300 and (not known or narrated = before), false) as cuts, greatest(c0, s0 - 120) as a0, least(c1, s1 + 120) as z0 from met),
capped as (select *, coalesce(not cuts and s0 - far > 1000, false) as capped from decided),
parts as (select *, sum(case when cuts or capped then 1 else 0 end) over (partition by source_id, clip_idx order by s0, seg_idx rows between unbounded preceding and current row) as part from capped),
rough as (select source_id, clip_idx, part, max(z0) as z0, arg_min({{'a': a0, 'far': far, 'capped': capped, 's0': s0, 'c0': c0, 'c1': c1}}, (s0, seg_idx)) as f from parts group by 1, 2, 3),
ended as (select *, case when coalesce(lead(f.capped) over w, false) then greatest(z0, least(f.c1, lead(f.far) over w + 500)) else z0 end as z,
  case when f.capped then least(f.a, greatest(f.c0, f.s0 - 500)) else f.a end as own from rough window w as (partition by source_id, clip_idx order by part)),
islands as (select source_id, clip_idx, greatest(own, coalesce(lag(z) over (partition by source_id, clip_idx order by part), own)) as a, z from ended), {ABSORBED}"""


@query(f"with {GAPS} {PIECES_OUT}")
def clip_silence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.cut_clips(*_silent(spark, sf_dir), BY, "clip_idx", clips.AGGRESSIVE)


@query(f"""with {GAPS}, kept as (select source_id, clip_idx, sum(end_ms - start_ms) as kept from pieces group by 1, 2)
select source_id, clip_idx, cast(greatest(0, end_ms - start_ms - coalesce(kept, 0)) as bigint) as removed_ms from good left join kept using (source_id, clip_idx)""")
def clip_silence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _silent(spark, sf_dir)
    return clips.removed(c, clips.cut_clips(c, s, BY, "clip_idx", clips.AGGRESSIVE), BY, "clip_idx")


@query(f"""with {CANDIDATES}, cut as (select source_id, cand_idx, start_ms, start_ms + (end_ms - start_ms) // 2 as end_ms from candidates),
t as (select source_id, sum(end_ms - start_ms) as o, sum((end_ms - start_ms) // 2) as c from candidates group by 1),
back as (select source_id from t where c < 200000000 and o <= 600000000)
select source_id, cand_idx, start_ms, end_ms from candidates where source_id in (select source_id from back) union all select * from cut where source_id not in (select source_id from back)""")
def silence_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("source_id", "cand_idx", "start_ms", "end_ms")
    half = c.withColumn("end_ms", F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2).cast(LONG))
    return clips.rollback(c, half, BY, 200_000_000, 600_000_000)


# Documents.


@query(f"with {SEGMENTS} select source_id, start_ms, end_ms, text from segments")
def segments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.read_segments(documents.write_segments(segments(spark, sf_dir), "source_id"), "source_id")


@query(f"""with {SEGMENTS} select source_id, count(*) as clips, cast(sum(end_ms - start_ms) as bigint) as total_ms,
  string_agg(seg_idx || speaker || start_ms || '-' || end_ms, ' ' order by seg_idx) as timeline from segments group by 1""")
def edit_plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = documents.edit_plan(segments(spark, sf_dir).withColumnRenamed("speaker", "role"), "source_id", "seg_idx")
    read = F.from_json("plan", "clips long, total_ms long, timeline array<struct<seg_idx:long,role:string,start_ms:long,end_ms:long>>")
    line = F.transform(read["timeline"], lambda c: F.concat(c["seg_idx"].cast("string"), c["role"], c["start_ms"].cast("string"), F.lit("-"), c["end_ms"].cast("string")))
    return plan.select("source_id", read["clips"].alias("clips"), read["total_ms"].alias("total_ms"), F.array_join(line, " ").alias("timeline"))


@query(f"""with {CANDIDATES}, k as (select source_id, cand_idx, case when cand_idx % 4 <> 0 then cast(cand_idx as bigint) end as candidate_index, kind from candidates where end_ms > start_ms),
n as (select *, sum(case when candidate_index is null then 1 else 0 end) over (partition by source_id order by cand_idx rows between unbounded preceding and current row) as place,
  coalesce(max(candidate_index) over (partition by source_id), -1) as top from k)
select source_id, cand_idx, cast(coalesce(candidate_index, top + place) as bigint) as candidate_index from n""")
def moments_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumnRenamed("kind", "description").withColumn("candidate_index", F.when(F.col("cand_idx") % 4 != 0, F.col("cand_idx").cast(LONG)))
    return documents.valid_moments(c, BY, "cand_idx").select("source_id", "cand_idx", "candidate_index")


@query("""select event_id, case when event_id % 3 = 0 then 'a' || event_id else 'b' end as title, case when event_id % 2 = 0 then 0.25 else 0.5 end::double as score,
  case when event_type in ('highlight', 'block') then event_type else 'normal' end as shorts_type from events""")
def story_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = table(spark, sf_dir, "events")
    title = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a"), F.col("event_id")))
    answer = F.to_json(F.struct(title.alias("title"), F.lit("b").alias("main_title"), F.when(F.col("event_id") % 2 == 0, 0.25).alias("score"), F.col("event_type").alias("type")))
    return event.select("event_id", documents.story(answer).alias("s")).select("event_id", "s.*")


#: A document by event: its stamp by type, one clip of the event's value, a narration at its number's place.
@query("""select event_id, case when event_type = 'error' then 'unknown schema' when floor(value) < 100 then 'clips: times'
  when event_type = 'view' then 'images: need the newest schema' when event_type = 'click' then 'clips: role' when value > 300 then 'tts: blank' else 'ok' end as reason from events""")
def override_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "view", "edit_overrides/v2").otherwise("edit_overrides/v3")
    clip = F.format_string('{"start_sec":100,"end_sec":%d.5,"role":"%s"}', F.floor("value"), F.when(F.col("event_type") == "click", "intro").otherwise("hook"))
    cue = F.format_string('{"source_time_sec":%d,"text":"%s","duration_sec":2}', "event_id", F.when(F.col("value") > 300, " ").otherwise("said"))
    images = F.when(F.col("event_type") == "view", ',"images":[{"source_time_sec":1,"duration_sec":2}]').otherwise("")
    document = F.concat(F.lit('{"schema":"'), stamp, F.lit('","clips":['), clip, F.lit('],"tts":['), cue, F.lit("]"), images, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", documents.override_reason(document).alias("reason"))


@query("""with r as (select event_type, cast(floor(value) as bigint) as s, value > 100 as flag from events)
select event_type, cast(sum(case when flag then 0 else s end) as bigint) as plain_s, cast(sum(case when flag then s else 0 end) as bigint) as flagged_s, cast(sum(case when flag then 5 * s else 2 * s end) as bigint) as cost from r group by 1""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast(LONG).alias("s"), (F.col("value") > 100).alias("flag"))
    return documents.usage(rows, ["event_type"], "s", "flag", 2, 5)


@query(f"""with {CANDIDATES}, r as (select *, row_number() over (partition by source_id order by score desc, cand_idx) as rank from candidates)
select source_id, cand_idx from r where rank = 1 or score >= 400""")
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.top(candidates(spark, sf_dir), BY, [F.col("score").desc(), F.col("cand_idx")], 1 << 30, "rank")
    return documents.score_floor(ranked, BY, "rank", "score", 400).select("source_id", "cand_idx")


@query(f"""with {CANDIDATES}, s as (select kind, end_ms - start_ms as total_ms, (end_ms - start_ms) // (2 + cand_idx % 4) as silent_ms from candidates where end_ms > start_ms)
select kind, count(*) as files, cast(floor(cast(sum(silent_ms) as bigint)::double / cast(sum(total_ms) as bigint) * 1000) as bigint) as weighted,
  cast(sum(silent_ms * 1000 // total_ms) // count(*) as bigint) as mean from s group by 1""")
def silence_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("end_ms") - F.col("start_ms")
    files = candidates(spark, sf_dir).select("kind", total.alias("total_ms"), F.expr("(end_ms - start_ms) div (2 + cand_idx % 4)").alias("silent_ms"))
    return documents.silence_ratio(files, "kind").select("kind", "files", F.col("weighted").cast(LONG).alias("weighted"), F.col("mean").cast(LONG).alias("mean"))


# Transcripts and subtitles.


@query(r"""select doc_id, len(regexp_extract_all(text, 'the')) as n_0, len(regexp_extract_all(text, '\.')) as n_1 from documents""")
def doc_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [c.cast(LONG).alias(f"n_{i}") for i, c in enumerate(transcripts.count_literals(F.col("text"), ["the", "."]))]
    return table(spark, sf_dir, "documents").select("doc_id", *counts)


@query(f"""with {SEGMENTS}, n as (select *, row_number() over (partition by source_id order by seg_idx) as n from segments)
select source_id, string_agg(n || '. ' || left(text, 100), chr(10) order by n) as summary from n where n <= 8 group by 1""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.summary(segments(spark, sf_dir), BY, "seg_idx")


WORDS = f"""{SEGMENTS}, words as (select source_id, seg_idx * 100000 + i as word_idx, start_ms + i * 60 as start_ms, start_ms + i * 60 + 50 as end_ms, w as text from (
  select source_id, seg_idx, start_ms, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as i from segments))"""


@query(f"""with {WORDS}, m as (select *, coalesce(sum(case when regexp_matches(text, '[.!?]$') then 1 else 0 end) over (partition by source_id order by word_idx rows between unbounded preceding and 1 preceding), 0) as sentence from words)
select source_id, cast(sentence as bigint) as sentence, cast(min(start_ms) as bigint) as start_ms, cast(max(end_ms) as bigint) as end_ms, string_agg(text, ' ' order by word_idx) as text from m group by 1, 2""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = segments(spark, sf_dir).select("source_id", "start_ms", F.posexplode(F.split("text", " ", -1)).alias("i", "text"), "seg_idx")
    timed = words.select("source_id", (F.col("seg_idx") * 100_000 + F.col("i")).alias("word_idx"), (F.col("start_ms") + F.col("i") * 60).alias("start_ms"), (F.col("start_ms") + F.col("i") * 60 + 50).alias("end_ms"), "text")
    return transcripts.split_sentences(timed, BY, "word_idx")


#: Turns claim what they and the next turn say, odd ones a minute too late.
CLAIMS = f"""{SEGMENTS}, n as (select *, {MARKS.format("text")} as n from segments),
line as (select *, coalesce(sum(length(n)) over (partition by source_id order by start_ms, seg_idx rows between unbounded preceding and 1 preceding), 0) as off from n where n <> ''),
whole as (select source_id, string_agg(n, '' order by start_ms, seg_idx) as t from line group by 1),
claims as (select source_id, seg_idx, start_ms + (seg_idx % 2) * 60000 as c0, end_ms + (seg_idx % 2) * 60000 as c1, n || coalesce(lead(n) over (partition by source_id order by seg_idx), '') as q from n),
wanted as (select *, q[1:greatest(10, cast(floor(length(q) * 0.6::double) as bigint))] as x from claims where length(q) >= 10),
hits as (select source_id, seg_idx, c0, c1, lx, unnest(places) as pos from (
  select w.source_id, seg_idx, c0, c1, length(x) as lx, list_filter(range(0, length(t)), lambda i: t[i + 1:i + length(x)] = x) as places from wanted w join whole using (source_id))),
timed as (select h.source_id, h.seg_idx, c0, c1, pos, a.start_ms as s, b.end_ms as e from hits h
  join line a on a.source_id = h.source_id and a.off <= pos and pos < a.off + length(a.n) join line b on b.source_id = h.source_id and b.off <= pos + lx - 1 and pos + lx - 1 < b.off + length(b.n))"""


@query(f"""with {CLAIMS}, j as (select source_id, seg_idx, not bool_or(s between c0 - 5000 and c1 + 5000 or e between c0 - 5000 and c1 + 5000) as problem, arg_min(s, pos) as s, arg_min(e, pos) as e from timed group by 1, 2)
select n.source_id, n.seg_idx, coalesce(problem, false) as problem, case when problem then s end as found_s, case when problem then e end as found_e from n left join j using (source_id, seg_idx)""")
def quotes_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    ahead = F.lead("text").over(Window.partitionBy("source_id").orderBy("seg_idx"))
    late = (F.col("seg_idx") % 2) * 60_000
    told = s.select("source_id", "seg_idx", F.concat("text", F.lit(" [1.5~2] "), F.coalesce(ahead, F.lit(""))).alias("transcript"), F.lit(None).cast("array<string>").alias("lines"),
                    (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"))
    return quotes.misplaced(told, s, BY, "seg_idx")


@query(f"""with {CANDIDATES} select source_id, cand_idx, greatest(start_ms, 0) as start_ms, least(end_ms, 1800000000000) as end_ms from candidates
where end_ms <= 1800000003000 and start_ms < 1800000000000 and least(end_ms, 1800000000000) - greatest(start_ms, 0) >= 200""")
def clip_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sanitise(candidates(spark, sf_dir).select("source_id", "cand_idx", "start_ms", "end_ms"), F.lit(1_800_000_000_000))


@query("""select event_id, case when event_id % 2 = 0 then ['b', 'c'] else ['a', 'b', 'c'] end as rules from events""")
def rules_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(" b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    return table(spark, sf_dir, "events").select("event_id", documents.merge_rules(base, F.array(F.lit("b "), F.lit(""), F.lit("c"))).alias("rules"))


@query(f"with {SEGMENTS} select source_id, cast(sum(end_ms - start_ms) as bigint) as total_ms, cast(avg(length(trim(text))) * 1000 as bigint) as mean_length from segments where text <> '' group by 1")
def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = segments(spark, sf_dir).where("text <> ''")
    return said.groupBy("source_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.round(F.avg(F.length(F.trim("text"))) * 1000).cast(LONG).alias("mean_length"))

