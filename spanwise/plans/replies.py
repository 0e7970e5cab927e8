"""Queries of answers, extensions and character indices: answers are built from events, and judged in SQL from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, clips, intervals
from .catalogue import BY, LONG, query
from .edits import SPEECH_CLIPS, _speech_clips
from .views import CANDIDATES, SEGMENTS, candidates, segments, table


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer an event: its storylines under several names, now and then without a key, a title or a storyline."""
    n = F.col("event_id")
    span = lambda least: F.struct(n.alias("start_sec"), F.when(n % least != 0, n + 5).alias("end_sec"))
    high = F.struct(F.when(n % 11 != 0, "highlight").alias("shorts_type"), F.when(n % 13 != 0, n % 100 / 100).alias("score"), F.when(n % 17 != 0, n).alias("start_sec"), (n + 9).alias("end_sec"))
    tale = F.struct(F.lit("storytelling").alias("shorts_type"), F.lit(0.5).alias("score"), F.when(n % 4 == 0, "반전형").otherwise("odd").alias("sequence_type"), F.struct(span(19).alias("hook"), F.when(n % 23 != 0, span(29)).alias("payoff")).alias("storyline"))
    rows = F.concat(F.lit("["), F.when(n % 3 > 0, F.concat(F.to_json(high), F.lit(","))).otherwise(""), F.to_json(tale), F.lit("]"))
    name = F.when(n % 5 == 0, "stories").when(n % 5 == 1, "output").otherwise("storylines")
    title = F.when(n % 7 == 0, "").when(n % 7 == 1, F.concat(F.lit(',"title_line1":"'), F.col("event_type"), F.lit('"'))).otherwise(F.concat(F.lit(',"title_txt":"a title of more than twenty letters '), n.cast("string"), F.lit('"')))
    body = F.when(n % 31 == 0, F.lit('{"stories":[]')).otherwise(F.concat(F.lit('{"'), name, F.lit('":'), rows))
    return table(spark, sf_dir, "events").select("event_id", F.concat(body, title, F.lit("}")).alias("document"))


TOLD = """told as (select event_id as n, event_type as kind, case when event_id % 3 > 0 then 1 else 0 end as t from events),
judged as (select *, case when n % 31 = 0 then 'no storylines' when n % 7 = 0 then 'no title' when t = 1 and n % 11 = 0 then 'storyline 0: no shorts_type' when t = 1 and n % 13 = 0 then 'storyline 0: no score'
  when t = 1 and n % 17 = 0 then 'storyline 0: no start_sec' when n % 19 = 0 then 'storyline ' || t || ': no hook end_sec' when n % 23 = 0 then 'storyline ' || t || ': no payoff'
  when n % 29 = 0 then 'storyline ' || t || ': no payoff end_sec' else 'ok' end as reason from told)"""


@query(f"with {TOLD} select n as event_id, reason from judged")
def story_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.story_reasons(_told(spark, sf_dir), "event_id")


@query(f"""with {TOLD}, rows as (select *, unnest(case when t = 1 then [0, 1] else [0] end) as i from judged where reason = 'ok'), titled as (select *, 'a title of more than twenty letters ' || n as whole, t = 1 and i = 0 as high from rows)
select n as event_id, cast(i as int) as story_idx, case when high then 'highlight' else 'storytelling' end as shorts_type, case when high then n % 100 / 100.0::double else 0.5::double end as score,
  case when high then null when n % 4 = 0 then '반전형' else '여정몰입형' end as sequence_type, case when n % 7 = 1 then kind else left(whole, 20) end as title_line1, case when n % 7 = 1 then '' else substr(whole, 21, 20) end as title_line2 from titled""")
def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.stories(_told(spark, sf_dir), "event_id").drop("ending_hook", "story")


@query(f"""with {SEGMENTS}, m as (select source_id, cast(row_number() over (partition by source_id order by seg_idx) - 1 as int) as moment_idx, seg_idx, speaker, start_ms, end_ms, text, case when seg_idx % 3 = 0 then cast(seg_idx as bigint) end as own, seg_idx % 5 <> 4 as good from segments),
n as (select *, coalesce(max(own) over (partition by source_id), -1) as top, sum(case when own is null and good then 1 else 0 end) over (partition by source_id order by moment_idx rows between unbounded preceding and current row) as place from m)
select source_id, moment_idx, cast(coalesce(own, top + place) as bigint) as candidate_index, start_ms, end_ms, text as description, case when seg_idx % 2 = 0 then speaker else '' end as reason from n where good""")
def moment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_idx")
    second = lambda c: (F.col(c) / 1000).cast("decimal(18,3)")
    moment = F.struct(i, second("start_ms").alias("start_sec"), second("end_ms").alias("end_sec"), F.when(i % 5 != 4, F.col("text")).alias("description"), F.when(i % 3 == 0, i.cast(LONG)).alias("candidate_index"), F.when(i % 2 == 0, F.col("speaker")).alias("reason"))
    rows = F.transform(F.array_sort(F.collect_list(moment)), lambda m: m.dropFields("seg_idx"))
    told = segments(spark, sf_dir).groupBy("source_id").agg(F.to_json(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("chunk_start_sec"), F.lit(1).alias("chunk_end_sec"), F.lit("s").alias("summary"), rows.alias("candidate_moments"))).alias("document"))
    return answers.moments(told, "source_id").drop("transcript")


@query("""select event_id, case when event_id % 6 = 0 then 'unknown key mood' when event_id % 6 = 1 then 'rules is no list of texts' when event_id % 6 = 2 then 'tone is no text' when event_id % 6 = 3 then 'no object' else 'ok' end as reason,
  case when event_id % 6 = 4 then event_type end as first_avoided, case when event_id % 6 = 5 then 'dry' end as tone from events""")
def guide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id") % 6, F.col("event_type")
    document = (
        F.when(n == 0, F.lit('{"mood":1,"_note":2}')).when(n == 1, F.lit('{"rules":["a",null]}')).when(n == 2, F.lit('{"tone":["a"]}')).when(n == 3, F.lit("[]"))
        .when(n == 4, F.concat(F.lit('{"avoid":[" ","'), kind, F.lit(' "]}'))).otherwise(F.lit('{"_a":1,"tone":" dry "}'))
    )
    return table(spark, sf_dir, "events").select("event_id", answers.guide_reason(document).alias("reason"), answers.guide(document)["avoid"][0].alias("first_avoided"), answers.guide(document)["tone"].alias("tone"))


@query(f"""with {CANDIDATES}, wide as (select source_id, cand_idx, case when score % 3 = 0 then least(start_ms, start_ms - 3600000) else start_ms end as s, case when score % 3 = 0 then greatest(end_ms, end_ms - 1800000 + score * 7200) else end_ms end as e from candidates),
m as (select *, max(e) over (partition by source_id order by s, e, cand_idx rows between unbounded preceding and 1 preceding) as pm from wide where e > s),
i as (select *, sum(case when pm is null or s > pm then 1 else 0 end) over (partition by source_id order by s, e, cand_idx rows between unbounded preceding and current row) as island from m),
l as (select source_id, island, max(e) - min(s) as len from i group by 1, 2) select source_id, count(*) as pieces, cast(sum(len) as bigint) as covered_ms from l group by 1""")
def event_coverage_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    ext = F.struct((F.col("score") % 3 == 0).alias("needed"), (F.col("start_ms") - 3_600_000).alias("start_ms"), (F.col("end_ms") - 1_800_000 + F.col("score") * 7200).alias("end_ms"))
    return intervals.coverage(intervals.widened(c.withColumn("context_extension", ext)), BY)


@query(f"""with {SPEECH_CLIPS}, samples as (select s.source_id, speaker as character, seg_idx as a, s.start_ms as s, s.end_ms as e, i, s.start_ms + i * 700 - 350 as t, (seg_idx * 13 + i * 29) % 100 / 100.0::double as x, (seg_idx * 7 + i * 31) % 100 / 100.0::double as y from segments s, (select unnest(range(4)) as i)),
asks as (select source_id, clip_idx, case when clip_idx % 2 = 0 then 'user' else 'assistant' end as character, start_ms + 450 as t from clips),
met as (select a.source_id, a.clip_idx, x, y, row_number() over (partition by a.source_id, a.clip_idx order by abs(s.t - a.t), s.a, s.i) as place from asks a join samples s on a.source_id = s.source_id and a.character = s.character and abs(s.t - a.t) <= 3000 and a.t between s.s - 1000 and s.e + 1000)
select a.source_id, a.clip_idx, x * 1920 as x, y * 1080 as y from asks a left join met m on m.source_id = a.source_id and m.clip_idx = a.clip_idx and m.place = 1""")
def clip_index_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_idx")
    samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("start_ms") + k * 700 - 350).alias("t_ms"), ((i * 13 + k * 29) % 100 / 100).alias("x"), ((i * 7 + k * 31) % 100 / 100).alias("y")))
    shown = segments(spark, sf_dir).select("source_id", i.alias("appearance_idx"), F.col("speaker").alias("character"), "start_ms", "end_ms", samples.alias("samples"))
    asks = _speech_clips(spark, sf_dir).select("source_id", "clip_idx", F.when(F.col("clip_idx") % 2 == 0, "user").otherwise("assistant").alias("character"), (F.col("start_ms") + 450).alias("at_ms"))
    return clips.find_in_index(asks, shown, BY, "clip_idx", 1920, 1080).select("source_id", "clip_idx", "x", "y")
