"""Queries of snapping whole clips, muted clips, doubtful spans on the edit axis, restored aliases, fates, scripts and speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import checks, clips, folds, intervals
from .catalogue import BY, LONG, query
from .edits import SPEECH_CLIPS, _speech_clips
from .views import CANDIDATES, SEGMENTS, candidates, segments, table


@query(f"""with {SPEECH_CLIPS}, marks as (select distinct source_id, t from (select source_id, start_ms as t from segments where seg_idx % 3 = 0 union all select source_id, end_ms from segments where seg_idx % 3 = 0)),
near as (select c.source_id, c.clip_idx, c.start_ms, c.end_ms, coalesce((select arg_min(t, (abs(t - c.start_ms), t)) from marks m where m.source_id = c.source_id and abs(t - c.start_ms) <= 2000), c.start_ms) as a,
  coalesce((select arg_min(t, (abs(t - c.end_ms), t)) from marks m where m.source_id = c.source_id and abs(t - c.end_ms) <= 2000), c.end_ms) as z from clips c)
select source_id, clip_idx, case when z - a > 200 then a else start_ms end as start_ms, case when z - a > 200 then z else end_ms end as end_ms from near""")
def clip_snap_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = intervals.boundaries(segments(spark, sf_dir).where("seg_idx % 3 = 0"), BY)
    return intervals.snap_clips(_speech_clips(spark, sf_dir), marks, BY, "clip_idx", "at", 2000).select("source_id", "clip_idx", "start_ms", "end_ms")


@query(f"""with {SPEECH_CLIPS}, wide as (select source_id, start_ms - 300 as a, start_ms + 400 as z from clips),
met as (select * from segments s where exists (select 1 from wide w where w.source_id = s.source_id and s.start_ms < w.z and s.end_ms > w.a)),
n as (select *, row_number() over (partition by source_id, text, (start_ms + 5) // 10, (end_ms + 5) // 10 order by seg_idx) as n from met) select source_id, cast(seg_idx as bigint) as seg_idx from n where n = 1""")
def segments_in_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _speech_clips(spark, sf_dir).select("source_id", (F.col("start_ms") - 300).alias("r_start"), (F.col("start_ms") + 400).alias("r_end"))
    return intervals.touched(segments(spark, sf_dir), wide, BY).select("source_id", F.col("seg_idx").cast(LONG).alias("seg_idx"))


AXIS = f"""{SPEECH_CLIPS}, axis as (select *, clip_idx % 2 = 0 as heard, case when clip_idx % 3 = 1 then ' clip ' || clip_idx else ' ' end as own,
  coalesce(sum(end_ms - start_ms) over (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding), 0) as base from clips where end_ms > start_ms)"""


def _muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("clip_idx")
    return _speech_clips(spark, sf_dir).withColumns({"use_original_audio": i % 2 == 0, "subtitle": F.when(i % 3 == 1, F.concat(F.lit(" clip "), i)).otherwise(" ")})


@query(f"""with {AXIS}, said as (select a.source_id, clip_idx, cast(seg_idx as bigint) as seg_idx, base + greatest(s.start_ms, a.start_ms) - a.start_ms as x, base + least(s.end_ms, a.end_ms) - a.start_ms as y, trim(text) as text
  from axis a join segments s on a.source_id = s.source_id and s.start_ms < a.end_ms and s.end_ms > a.start_ms where heard and least(s.end_ms, a.end_ms) - greatest(s.start_ms, a.start_ms) >= 50)
select source_id, clip_idx, seg_idx, cast(x as bigint) as start_ms, cast(y as bigint) as end_ms, text from said
union all select source_id, clip_idx, null, cast(base as bigint), cast(base + end_ms - start_ms as bigint), trim(own) from axis where not heard and trim(own) <> ''""")
def clip_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = clips.subtitled(_muted(spark, sf_dir), segments(spark, sf_dir), BY)
    return said.select("source_id", "clip_idx", F.col("seg_idx").cast(LONG).alias("seg_idx"), F.col("start_ms").cast(LONG).alias("start_ms"), F.col("end_ms").cast(LONG).alias("end_ms"), "text")


@query(f"""with {AXIS}, doubt as (select source_id, start_ms + 100 as a, end_ms + 150 as z from segments where seg_idx % 5 = 2),
seen as (select x.source_id, base + greatest(a, x.start_ms) - x.start_ms as a, base + least(z, x.end_ms) - x.start_ms as z from axis x join doubt d on x.source_id = d.source_id and a < x.end_ms and z > x.start_ms where least(z, x.end_ms) - greatest(a, x.start_ms) >= 50),
rows as (select source_id, clip_idx, base as s, base + 900 as e from axis)
select source_id, clip_idx, exists (select 1 from seen d where d.source_id = r.source_id and r.s < d.z and r.e > d.a and least(r.e, d.z) - greatest(r.s, d.a) >= 50) as uncertain from rows r""")
def clip_uncertain_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _speech_clips(spark, sf_dir)
    rows = intervals.edit_axis(cut.where("end_ms > start_ms"), BY, ["clip_idx"]).select("source_id", "clip_idx", F.col("edit_start").alias("start_ms"), (F.col("edit_start") + 900).alias("end_ms"))
    doubt = segments(spark, sf_dir).where("seg_idx % 5 = 2").select("source_id", (F.col("start_ms") + 100).alias("r_start"), (F.col("end_ms") + 150).alias("r_end"))
    return clips.uncertain_on_axis(rows, doubt, cut, BY, "clip_idx").select("source_id", "clip_idx", "uncertain")


@query(f"""with {CANDIDATES}, known as (select source_id as chunk, score as place, arg_max(start_ms, cand_idx) as s, arg_max(end_ms, cand_idx) as e, arg_max(kind, cand_idx) as d from candidates where cand_idx % 2 = 0 group by 1, 2),
asks as (select cand_idx, source_id as chunk, score as place, case when cand_idx % 7 = 0 then source_id + 1 end as to_chunk, case when cand_idx % 7 = 0 then (score * 3) % 1000 end as to_place from candidates)
select cand_idx as clip_idx, case when s is not null then coalesce(to_chunk, a.chunk) else a.chunk end as chunk_index, case when s is not null then coalesce(to_place, a.place) else a.place end as candidate_index,
  coalesce(s, 1) as start_ms, coalesce(e, 2) as end_ms, case when d <> '' then d else 'own' end as description from asks a left join known k on k.chunk = coalesce(to_chunk, a.chunk) and k.place = coalesce(to_place, a.place)""")
def clip_restore_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    known = clips.lookup(c.where("cand_idx % 2 = 0").select(F.col("source_id").alias("chunk_index"), F.col("score").alias("candidate_index"), "start_ms", "end_ms", F.col("kind").alias("description"), "cand_idx"), "cand_idx")
    asks = c.select(F.col("cand_idx").alias("clip_idx"), F.col("source_id").alias("chunk_index"), F.col("score").alias("candidate_index"), F.lit(1).cast(LONG).alias("start_ms"), F.lit(2).cast(LONG).alias("end_ms"), F.lit("own").alias("description"))
    # An alias is a pair's, not a row's: rows of one pair with another answer are told apart by a chunk of their own.
    plain, turned = asks.where("clip_idx % 7 <> 0"), asks.where("clip_idx % 7 = 0")
    aliases = turned.select("chunk_index", "candidate_index", (F.col("chunk_index") + 1).alias("to_chunk"), (F.col("candidate_index") * 3 % 1000).alias("to_candidate")).distinct()
    return clips.restore_times(plain, known).unionByName(clips.restore_times(turned, known, aliases)).select("clip_idx", "chunk_index", "candidate_index", "start_ms", "end_ms", "description")


@query("""with c as (select event_id, case when event_id % 17 <> 0 then event_id % 40 * 100 - 500 end as s, event_id % 40 * 100 - 500 + cast(floor(value) as bigint) * 7 as e, case when event_id % 19 <> 0 then event_id % 23 * 150 else 0 end as total from events)
select event_id, case when s is null then 'no times' when total > 0 and e > total + 3000 then 'past end' when total > 0 and greatest(s, 0) >= total then 'starts past end'
  when case when total > 0 then least(e, total) else e end - greatest(s, 0) < 200 then 'too short' when s < 0 or total > 0 and e > total then 'moved' else 'ok' end as fate from c""")
def clip_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    start = n % 40 * 100 - 500
    end = start + F.floor("value").cast(LONG) * 7
    total = F.when(n % 19 != 0, n % 23 * 150).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", checks.fate(F.when(n % 17 != 0, start), end, total).alias("fate"))


@query(r"""with d as (select doc_id, coalesce(text, '') || repeat('привет ', cast(case when doc_id % 3 = 0 then length(coalesce(text, '')) // 8 when doc_id % 3 = 1 then 40 else 0 end as bigint)) as text from documents),
n as (select doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(text, '[^\x{AC00}-\x{D7A3}]', '', 'g')) as native, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) as latin from d)
select doc_id, letters > 0 and letters - native - latin >= 0.5::double * letters as escapes from n""")
def doc_script_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    more = F.when(F.col("doc_id") % 3 == 0, F.floor(F.length(text) / 8)).when(F.col("doc_id") % 3 == 1, 40).otherwise(0).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", tx.escapes_language(F.concat(text, F.repeat(F.lit("привет "), more))).alias("escapes"))


FRAMES = f"""{CANDIDATES}, boxes as (select source_id, cand_idx, score, case when cand_idx % 7 = 0 then 0 when cand_idx % 3 = 0 then 1 else 2 end as faces,
    (score * 1.5)::double as x0, (cand_idx % 700)::double as y0, 100.0::double + score % 200 as w0, 120.0::double + score % 100 as h0, (score % 11 / 10.0)::double as m0,
    1500.0::double - score as x1, (cand_idx % 500)::double as y1, 150.0::double as w1, 90.0::double + score % 300 as h1, (cand_idx % 13 / 12.0)::double as m1,
    row_number() over (partition by source_id order by cand_idx) as n from candidates)"""
_near = lambda i, x, y: f"sqrt((x{i} + w{i} / 2 - {x}) * (x{i} + w{i} / 2 - {x}) + (y{i} + h{i} / 2 - {y}) * (y{i} + h{i} / 2 - {y}))"
_D = "sqrt((1920 * 1920 + 1080 * 1080)::double)"
_score = lambda i, x, y: f"(0.3::double * (w{i} * h{i} / 2073600) + 0.3::double * (1 - {_near(i, '960', '540')} / ({_D} / 2)) + 0.3::double * m{i} + 0.1::double * (1 - least({_near(i, x, y)} / {_D}, 1)))"
_STEP = f"""select source_id, cand_idx, n, case when faces = 0 then null when faces = 2 and s1 > s0 then 1 else 0 end as face, case when faces = 0 then null when faces = 2 and s1 > s0 then s1 else s0 end as score,
    case when faces > 0 and abs(gx - px) > 96 then 0.12::double * gx + (1 - 0.12::double) * px else px end as x, case when faces > 0 and abs(gy - py) > 54 then 0.12::double * gy + (1 - 0.12::double) * py else py end as y
  from (select *, case when faces = 2 and s1 > s0 then x1 + w1 / 2 else x0 + w0 / 2 end as gx, case when faces = 2 and s1 > s0 then y1 + h1 / 2 else y0 + h0 / 2 end as gy from (
    select b.*, p.x as px, p.y as py, {_score(0, 'p.x', 'p.y')} as s0, {_score(1, 'p.x', 'p.y')} as s1 from"""


@query(f"""with recursive {FRAMES}, walk as (select source_id, 0 as cand_idx, cast(0 as bigint) as n, cast(null as int) as face, cast(null as double) as score, 960.0::double as x, 540.0::double as y from boxes group by 1
  union all {_STEP} walk p join boxes b on b.source_id = p.source_id and b.n = p.n + 1)))
select source_id, cand_idx, face, round(score, 6) as score, round(x, 6) as x_center, round(y, 6) as y_center from walk where n > 0""")
def frame_follow_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, score = F.col("cand_idx"), F.col("score")
    face = lambda x, y, w, h, m: F.struct(*(c.cast("double").alias(k) for k, c in zip(("x", "y", "w", "h", "motion"), (x, y, w, h, m), strict=True)))
    one = face(score * 1.5, n % 700, 100.0 + score % 200, 120.0 + score % 100, score % 11 / 10.0)
    two = face(1500.0 - score, n % 500, F.lit(150.0), 90.0 + score % 300, n % 13 / 12.0)
    faces = F.when(n % 7 == 0, F.array(one).cast("array<struct<x:double,y:double,w:double,h:double,motion:double>>")).otherwise(F.array(one, two))
    faces = F.when(n % 7 == 0, F.slice(faces, 1, 0)).when(n % 3 == 0, F.slice(faces, 1, 1)).otherwise(faces)
    found = folds.follow_speaker(candidates(spark, sf_dir).select("source_id", "cand_idx", faces.alias("faces")), BY, "cand_idx", "faces", 1920, 1080)
    return found.select("source_id", "cand_idx", "face", *(F.round(c, 6).alias(c) for c in ("score", "x_center", "y_center")))
