"""More queries: beats, boundaries, notation, formats, keys and the other small operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import transcripts
from ..operators import channels, checks, clips, documents, intervals, ranking
from ..sources import subtitles
from .catalogue import BY, LONG, query
from .edits import SPEECH_CLIPS, WORDS, _speech_clips
from .views import CANDIDATES, SEGMENTS, candidates, segments, table

# Beats and boundaries: the assistant's turns are dropped from clips of four turns.

KEPT = f"""{SPEECH_CLIPS}, good as (select * from clips where end_ms > start_ms),
inside as (select c.source_id, clip_idx, c.start_ms as c0, c.end_ms as c1, greatest(c.start_ms, s.start_ms) as a, least(c.end_ms, s.end_ms) as z
  from good c join segments s on s.source_id = c.source_id and s.speaker = 'assistant' and s.start_ms < c.end_ms and s.end_ms > c.start_ms),
m as (select *, case when pm is null or a > pm then 1 else 0 end as fresh from (
  select *, max(z) over (partition by source_id, clip_idx order by a, z rows between unbounded preceding and 1 preceding) as pm from inside)),
g as (select source_id, clip_idx, c0, c1, island, min(a) as a, max(z) as z from (select *, sum(fresh) over (partition by source_id, clip_idx order by a, z rows between unbounded preceding and current row) as island from m) group by all),
parts as (select source_id, clip_idx, c0, c1, coalesce(lag(z) over (partition by source_id, clip_idx order by a), c0) as a, a as b from g
  union all select source_id, clip_idx, c0, c1, max(z), c1 from g group by all
  union all select source_id, clip_idx, start_ms, end_ms, start_ms, end_ms from good where (source_id, clip_idx) not in (select (source_id, clip_idx) from g)),
heads as (select p.*, (select min(s.start_ms) from segments s where s.source_id = p.source_id and s.start_ms < c1 and s.end_ms > c0 and s.start_ms >= a and s.start_ms < b) as head,
  (select max(s.end_ms) from segments s where s.source_id = p.source_id and s.start_ms < c1 and s.end_ms > c0 and s.end_ms <= b) as tail from parts p where b > a),
cut as (select source_id, clip_idx, na, case when b <> c1 and tail > na then tail else b end as nb from (select *, case when a <> c0 and head is not null then head else a end as na from heads)),
ranked as (select *, max(nb - na) over (partition by source_id, clip_idx) as top, row_number() over (partition by source_id, clip_idx order by nb - na desc, na) as n from cut where nb > na)"""


@query(f"""with {KEPT} select source_id, clip_idx, cast(na as bigint) as start_ms, cast(nb as bigint) as end_ms from ranked where nb - na >= 3000 or (top < 3000 and n = 1)
union all select source_id, clip_idx, start_ms, end_ms from good where (source_id, clip_idx) not in (select (source_id, clip_idx) from ranked)""")
def clip_kept_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    drops = s.where("speaker = 'assistant'").select("source_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return intervals.kept_intervals(_speech_clips(spark, sf_dir).where("end_ms > start_ms"), drops, s, BY, "clip_idx").withColumns({c: F.col(c).cast(LONG) for c in ("start_ms", "end_ms")})


@query(f"""with {SPEECH_CLIPS} select source_id, clip_idx, cast(row_number() over (partition by source_id, clip_idx order by greatest(c.start_ms, s.start_ms), s.start_ms, s.end_ms) - 1 as bigint) as beat_idx,
  greatest(c.start_ms, s.start_ms) as start_ms, least(c.end_ms, s.end_ms) as end_ms from clips c join segments s using (source_id) where c.start_ms < s.end_ms and c.end_ms > s.start_ms""")
def clip_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = segments(spark, sf_dir).select("source_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return intervals.clip_beats(_speech_clips(spark, sf_dir), beats, BY, "clip_idx").select("source_id", "clip_idx", F.col("beat_idx").cast(LONG).alias("beat_idx"), "start_ms", "end_ms")


@query(f"""with {SPEECH_CLIPS} select source_id, clip_idx, (select max(s.end_ms) from segments s where s.source_id = c.source_id and s.end_ms <= c.end_ms) as end_before,
  (select min(s.start_ms) from segments s where s.source_id = c.source_id and s.start_ms >= c.end_ms) as start_after from clips c""")
def clip_sentence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _speech_clips(spark, sf_dir).select("source_id", "clip_idx", "end_ms")
    return intervals.around(asked, segments(spark, sf_dir), BY, "clip_idx", "end_ms").drop("end_ms")


@query(f"with {SEGMENTS} select source_id, start_ms as at from segments union select source_id, end_ms from segments")
def conv_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.boundaries(segments(spark, sf_dir), BY)


@query(f"""with {SPEECH_CLIPS} select source_id, clip_idx, speaker as character, greatest(c.start_ms, s.start_ms) - c.start_ms as from_ms, least(c.end_ms, s.end_ms) - c.start_ms as to_ms
from clips c join segments s using (source_id) where c.start_ms < s.end_ms and c.end_ms > s.start_ms""")
def clip_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = segments(spark, sf_dir).select("source_id", F.col("speaker").alias("character"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return intervals.appearances(_speech_clips(spark, sf_dir), seen, BY, "clip_idx")


@query(f"""with {CANDIDATES}, n as (select *, row_number() over (partition by kind, score, (start_ms + 5) // 10, (end_ms + 5) // 10 order by cand_idx) as n from candidates) select cand_idx from n where n = 1""")
def event_distinct_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.distinct_rounded(candidates(spark, sf_dir), ["kind", "score"], order="cand_idx").select("cand_idx")


#: The rule read as it stands: per hit the others whose start lies in its window, then the last hit with enough of them.
@query(f"""with {SEGMENTS}, hits as (select * from segments where contains(lower(text), 'the')),
seen as (select a.source_id, a.seg_idx, a.start_ms as t, count(*) as n, min(b.start_ms) as start_ms from hits a join hits b on a.source_id = b.source_id and b.start_ms between a.end_ms - 30000 and a.end_ms group by 1, 2, 3)
select source_id, arg_max(start_ms, (t, seg_idx)) as start_ms from seen where n >= 3 group by 1""")
def conv_last_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = segments(spark, sf_dir).where(F.lower("text").contains("the"))
    return intervals.last_cluster(hits, BY, "start_ms", "end_ms", 30_000, 3, "seg_idx")


CREDITS = f"""{SEGMENTS}, lengths as (select source_id, max(end_ms) as total from segments group by 1),
hits as (select s.*, total from segments s join lengths using (source_id) where contains(lower(text), 'the') or contains(lower(text), 'you')),
first as (select * from hits where end_ms > 0 and start_ms < least(8000, total)), last as (select * from hits where end_ms > greatest(0, total - 8000) and start_ms < total),
ahead as (select a.source_id, a.seg_idx, a.start_ms as t, max(b.end_ms) as z from first a join first b on a.source_id = b.source_id and b.start_ms between a.start_ms and a.start_ms + 3000 group by 1, 2, 3 having count(*) >= 2),
back as (select a.source_id, a.seg_idx, a.start_ms as t, min(b.start_ms) as z from last a join last b on a.source_id = b.source_id and b.start_ms between a.end_ms - 3000 and a.end_ms group by 1, 2, 3 having count(*) >= 2),
found as (select source_id, total, cast(coalesce((select arg_min(z, t) from ahead a where a.source_id = l.source_id), 0) as bigint) as intro_end,
  cast(coalesce((select arg_max(z, (t, seg_idx)) from back b where b.source_id = l.source_id), total) as bigint) as credits_start from lengths l)"""


def _credits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    lengths = s.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    return lengths, transcripts.credits(s, lengths, BY, ["the", "you"], 8000, 3000, 2)


@query(f"with {CREDITS} select source_id, intro_end, credits_start from found")
def doc_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credits(spark, sf_dir)[1]


@query(f"""with {CREDITS}, s as (select *, source_id % 3 * 500 as si, source_id % 4 * 700 as sc, case when source_id % 5 = 0 then source_id % 7 * 900 end as vi, case when source_id % 5 < 2 then total - source_id % 3 * 400 end as vc from found),
u as (select *, greatest(si, coalesce(vi, 0), intro_end) as a, least(total - sc, coalesce(vc, total), credits_start) as z from s),
v as (select *, a < z as sound, a < z and (coalesce(vi, 0) > 0 or coalesce(vc, total) < total) as seen, a < z and (intro_end > 0 or credits_start < total) as heard, si > 0 or sc > 0 as hand from u),
w as (select *, cast(seen as int) + cast(heard as int) + cast(hand as int) as used from v)
select source_id, case when si + sc < total then cast(case when sound then a else si end as bigint) end as intro_end, case when si + sc < total then cast(case when sound then z else total - sc end as bigint) end as credits_start,
  case when si + sc >= total then 'impossible' when used = 0 then 'none' when used > 1 then 'hybrid' when seen then 'video' when heard then 'srt' else 'config' end as method,
  case when si + sc < total then cast(case when used = 0 then 100 when used > 1 and seen then 90 when used > 1 then 80 when seen then 85 when heard then 70 else 100 end as bigint) end as confidence_pct from w""")
def conv_exclusion_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, found = _credits(spark, sf_dir)
    n = F.col("source_id")
    seen = {"skip_intro": n % 3 * 500, "skip_credits": n % 4 * 700, "seen_intro": F.when(n % 5 == 0, n % 7 * 900), "seen_credits": F.when(n % 5 < 2, F.col("duration_ms") - n % 3 * 400)}
    read = found.withColumnsRenamed({"intro_end": "read_intro", "credits_start": "read_credits"})
    return transcripts.exclusion_zones(lengths.withColumns(seen).join(read, "source_id"), BY)


# Transcripts.

RULES = {"the": "THE", "and": "&", "you": "YOU"}
_RULED = "list_transform(string_split(text, ' '), lambda t: case t when 'the' then 'THE' when 'and' then '&' when 'you' then 'YOU' else t end)"


@query(f"with {SEGMENTS} select source_id, seg_idx, array_to_string({_RULED}, ' ') as text, cast(len(list_filter(string_split(text, ' '), lambda t: t in ('the', 'and', 'you'))) as int) as n_used from segments")
def turn_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("source_id", "seg_idx", transcripts.restore_notation(F.col("text"), RULES).alias("r")).select("source_id", "seg_idx", "r.text", F.size("r.used").alias("n_used"))


@query(f"""with {SEGMENTS}, t as (select unnest(string_split(text, ' ')) as t from segments)
select t || '→' || case t when 'the' then 'THE' when 'and' then '&' else 'YOU' end as rule, count(*) as n from t where t in ('the', 'and', 'you') group by 1""")
def notation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = segments(spark, sf_dir).select(transcripts.restore_notation(F.col("text"), RULES)["used"].alias("used"))
    return transcripts.rules_used(used)


@query(f"""with {WORDS} select source_id, cast(floor(coalesce(cast(sum(-length(text)) filter (where length(text) > 1) as double) / count(*) filter (where length(text) > 1), 0) * 1000) as bigint) as milli from words group by 1""")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = segments(spark, sf_dir).select("source_id", F.explode(F.split("text", " ", -1)).alias("text"))
    scored = words.withColumn("logprob", F.when(F.length("text") > 1, -F.length("text").cast("double")))
    return transcripts.confidence(scored, BY).select("source_id", F.floor(F.col("confidence") * 1000).cast(LONG).alias("milli"))


@query("""with t as (select trim(p_name) as term, min(p_partkey) as p_partkey from part where length(trim(p_name)) between 1 and 50 and len(string_split_regex(trim(p_name), '\\s+')) <= 5 and not regexp_matches(p_name, '[<>{}\\[\\]\\\\]') group by 1)
select term, p_partkey from t order by p_partkey, term limit 1000""")
def part_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.key_terms(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query(r"""with p as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, trim(regexp_replace(role || ': ' || text, '(^|\s)[^\s:]{1,20}:\s', '\1', 'g')) as plain,
  replace(translate('{' || text || '}', '{}', '()'), chr(10), '\N') as escaped, false as escapes,
  case when before is not null then cast(floor(len(list_intersect(list_distinct(string_split(text, '')), list_distinct(string_split(before, ''))))::double * 1000 / len(list_distinct(string_split(text, '')))) as bigint) end as alike from p""")
def turn_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.select(
        "conv_id", "turn", tx.strip_speaker(F.concat_ws(": ", "role", tx.strip_emoji(F.concat(F.lit("🙂"), "text")))).alias("plain"),
        tx.escape_subtitle(F.concat(F.lit("{"), "text", F.lit("}"))).alias("escaped"), tx.escapes_language(F.col("text")).alias("escapes"),
        F.floor(tx.alike(F.col("text"), F.col("before")) * 1000).cast(LONG).alias("alike"),
    )


@query("select p_partkey, '&H00' || upper(substr(h, 5, 2)) || upper(substr(h, 3, 2)) || upper(substr(h, 1, 2)) as colour from (select p_partkey, substr(md5(p_name), 1, 6) as h from part)")
def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.subtitle_colour(F.concat(F.lit("#"), F.left(F.md5("p_name"), F.lit(6)))).alias("colour"))


# Subtitle files: the four formats, written from turns and read again, content and all.

_PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))"
_SPOKEN = f"with {SEGMENTS} select source_id, row_number() over (partition by source_id order by seg_idx) - 1 as seg_idx, start_ms, end_ms, {{text}} as text from segments where {_PLAIN} <> ''"


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), " +", " "))
    return segments(spark, sf_dir).withColumn("text", text).where("text <> ''")


def _read(files: DataFrame) -> DataFrame:
    read = subtitles.parse(files)
    return read.select(F.regexp_extract("path", r"(\d+)", 1).cast(LONG).alias("source_id"), F.col("seg_idx").cast(LONG).alias("seg_idx"), "start_ms", "end_ms", "text")


def _file(rows: DataFrame, kind: str, line: Column, head: str, between: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line"))))["line"]
    files = rows.groupBy("source_id").agg(F.concat(F.lit(head), F.array_join(ordered, between)).alias("value"))
    return files.select(F.concat(F.col("source_id").cast("string"), F.lit(f".{kind}")).alias("path"), "value")


def _clock(ms: Column, mark: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


@query(_SPOKEN.format(text=_PLAIN))
def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _plain(spark, sf_dir).withColumn("path", F.concat(F.col("source_id").cast("string"), F.lit(".srt")))
    return _read(subtitles.as_srt(named))


@query(_SPOKEN.format(text=f"speaker || ': ' || {_PLAIN}"))
def vtt_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.concat_ws(" --> ", _clock(F.col("start_ms"), "."), F.concat(_clock(F.col("end_ms"), "."), F.lit(" align:start")))
    line = F.concat(times, F.lit("\n<v "), "speaker", F.lit("><i>"), "text", F.lit("</i> [note]"))
    return _read(_file(_plain(spark, sf_dir), "vtt", line, "WEBVTT\n\n", "\n\n"))


@query(_SPOKEN.format(text=_PLAIN).replace("start_ms, end_ms,", "start_ms // 10 * 10 as start_ms, end_ms // 10 * 10 as end_ms,"))
def ass_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = subtitles.as_ass(_plain(spark, sf_dir).withColumn("path", F.concat(F.col("source_id").cast("string"), F.lit(".ass"))))
    return _read(written.withColumn("value", F.concat(F.lit("[Script Info]\nTitle: a\n\n[Events]\nFormat: Layer\n"), "value", F.lit("\n\n[Fonts]\nDialogue: 0,no"))))


@query(f"""with s as ({_SPOKEN.format(text=f"speaker || ': ' || {_PLAIN}")}) select source_id, seg_idx, start_ms, coalesce(lead(start_ms) over (partition by source_id order by start_ms), start_ms + 3000) as end_ms, text from s""")
def smi_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<SYNC Start="), F.col("start_ms").cast("string"), F.lit('><P Class="'), "speaker", F.lit('">'), "text", F.lit("<br>"))
    return _read(_file(_plain(spark, sf_dir), "smi", line, "<SAMI><BODY>\n", "\n"))


# Answers, caches, logs.


@query("""select event_id, '{"k":"a}\\"' || event_id || '","l":[1,{}]}' as value, cast(length(event_type) + 1 as int) as lost from events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('{"k":"a}\\"'), F.col("event_id").cast("string"), F.lit('","l":[1,{}]}'))
    answer = F.concat(F.lit("```json\nSure: "), value, F.lit("\n"), "event_type", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", subtitles.salvage_json(answer).alias("s")).select("event_id", "s.*")


@query("""with c as (select conv_id, turn, sha1(concat_ws(chr(0), text, role, 'normal', printf('%.2f', length(text) * 10 / 1000))) as key from conversations)
select conv_id, turn, key, file from c left join (select key, min(conv_id || '.mp3') as file from c where turn = 1 group by 1) using (key)""")
def cue_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("role").alias("voice"), F.lit("normal").alias("speed"), (F.length("text") * 10).alias("target_ms"))
    key = subtitles.cue_key(F.col("text"), F.col("voice"), F.col("speed"), F.col("target_ms"))
    cache = cues.where("turn = 1").groupBy(key.alias("key")).agg(F.min(F.concat(F.col("conv_id").cast("string"), F.lit(".mp3"))).alias("file"))
    return subtitles.cached_cues(cues, cache).select("conv_id", "turn", "key", "file")


@query("select doc_id, cast(length(text) as int) as n_text, cast(len(string_split(text, ' ')) as int) as n_words from documents")
def run_log_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.slim(table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ", -1).alias("words")))


@query(f"""with {CANDIDATES} select cand_idx as a, score as b, kind as type, cand_idx || ' -> ' || score || ': ' || case kind when 'view' then 'leads to' when 'click' then 'pays off' else kind end as line from candidates""")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = candidates(spark, sf_dir).select(F.col("cand_idx").alias("a"), F.col("score").alias("b"), F.col("kind").alias("type"))
    return documents.edge_text(edges, {"view": "leads to", "click": "pays off"})


@query(f"""with {CANDIDATES}, first as (select min(source_id) as s from candidates), own as (select cand_idx from candidates join first on source_id = s)
select source_id, cand_idx, case when source_id = s then start_ms + 1 else start_ms end as start_ms from candidates, first""")
def override_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    first = c.agg(F.min("source_id").alias("s"))
    variants = c.join(F.broadcast(first.select(F.col("s").alias("source_id"), F.lit(0).alias("z"))), "source_id", "left").withColumn("variant_id", F.when(F.col("z") == 0, 0).otherwise(F.col("source_id") + 1))
    variants = variants.select("variant_id", "source_id", "cand_idx", "start_ms")
    edited = variants.where("variant_id = 0").drop("variant_id").withColumn("start_ms", F.col("start_ms") + 1)
    return documents.apply_overrides(variants, edited).drop("variant_id")


CUES = f"""{SEGMENTS}, totals as (select source_id, max(end_ms) - 1000 as total from segments group by 1),
good as (select source_id, seg_idx, start_ms, least(end_ms, total) as end_ms, case when speaker in ('assistant', 'user') then speaker else 'assistant' end as voice
  from segments join totals using (source_id) where start_ms < total and end_ms > start_ms),
first as (select * from (select *, row_number() over (partition by source_id order by start_ms, seg_idx) as place from good) where place <= 5),
votes as (select source_id, voice, count(*) as n, min(place) as f from first group by 1, 2),
chosen as (select source_id, arg_max(voice, (n, -f)) as voice from votes group by 1)"""


@query(f"with {CUES} select source_id, seg_idx, start_ms, end_ms, chosen.voice from first join chosen using (source_id)")
def cues_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("total", F.max("end_ms").over(Window.partitionBy("source_id")) - 1000)
    cues = s.select("source_id", F.col("seg_idx").alias("cue_idx"), "start_ms", "end_ms", F.col("speaker").alias("voice"), "total")
    return documents.normalise_cues(cues, BY, ["assistant", "user"], "total").select("source_id", F.col("cue_idx").alias("seg_idx"), "start_ms", "end_ms", "voice")


PLACED = f"""{SPEECH_CLIPS}, edl as (select *, clip_idx // 2 as chunk, clip_idx % 2 as cand, coalesce(sum(end_ms - start_ms) over (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding), 0) as edit_start from clips where end_ms > start_ms),
cues as (select source_id, seg_idx, end_ms - 100 as t, seg_idx // 8 as chunk, seg_idx // 4 % 2 as cand from segments),
met as (select q.source_id, seg_idx, t, e.start_ms as s, e.end_ms as e, edit_start, clip_idx, case when e.start_ms <= t and t < e.end_ms and q.chunk = e.chunk and q.cand = e.cand then 1 when e.start_ms <= t and t < e.end_ms then 2
    when q.chunk = e.chunk and q.cand = e.cand and e.start_ms >= t then 3 when q.chunk = e.chunk and q.cand = e.cand then 4 end as tier from cues q join edl e on q.source_id = e.source_id),
best as (select * from (select *, row_number() over (partition by source_id, seg_idx order by tier, case when tier <= 2 then clip_idx when tier = 3 then s else -e end, clip_idx) as n from met where tier is not null) where n = 1),
put as (select source_id, seg_idx, edit_start - s + case when tier <= 2 then t when tier = 3 then s else greatest(s, e - 500) end as a from best)"""


@query(f"with {PLACED}, tot as (select source_id, sum(end_ms - start_ms) as total from edl group by 1) select source_id, seg_idx, cast(a as bigint) as start_ms, cast(least(a + 2000, total) as bigint) as end_ms from put join tot using (source_id) where least(a + 2000, total) - a >= 300")
def cue_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("source_id")
    edl = intervals.edit_axis(_speech_clips(spark, sf_dir).where("end_ms > start_ms"), BY, ["clip_idx"])
    edl = edl.withColumns({"c_chunk": F.floor(F.col("clip_idx") / 2), "c_cand": F.col("clip_idx") % 2})
    total = edl.select("source_id", F.sum(F.col("end_ms") - F.col("start_ms")).over(whole).alias("total")).distinct()
    cues = segments(spark, sf_dir).select("source_id", "seg_idx", (F.col("end_ms") - 100).alias("source_ms"), F.lit(2000).alias("dur_ms"), F.floor(F.col("seg_idx") / 8).alias("chunk_index"), (F.floor(F.col("seg_idx") / 4) % 2).alias("candidate_index"))
    placed = clips.place_cues(cues.join(total, "source_id"), edl, BY, "seg_idx")
    return placed.select("source_id", "seg_idx", F.col("start_ms").cast(LONG).alias("start_ms"), F.col("end_ms").cast(LONG).alias("end_ms"))


# Candidates of chunks, storylines.


@query(f"""with {CANDIDATES}, r as (select cand_idx, source_id, start_ms % 600000 as a, start_ms % 600000 + score * 1000 as z, cast(source_id % 7 as bigint) * 420000 as c0 from candidates),
m as (select *, max(z) over (partition by source_id) > 601000 as already from r) select cand_idx, a + case when already then 0 else c0 end as start_ms, z + case when already then 0 else c0 end as end_ms from m""")
def chunk_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("cand_idx", "source_id", (F.col("start_ms") % 600_000).alias("start_ms"), (F.col("start_ms") % 600_000 + F.col("score") * 1000).alias("end_ms"), ((F.col("source_id") % 7) * 420_000).alias("c0"), F.lit(600_000).alias("len"))
    return checks.absolute(c, BY, "c0", "len").select("cand_idx", "start_ms", "end_ms")


@query(f"""with {CANDIDATES} select cand_idx, score <= 500 and kind <> 'view' and end_ms + score <= start_ms + 86400500 as needed from candidates""")
def chunk_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    ext = F.struct((F.col("kind") != "view").alias("needed"), (F.col("start_ms") - F.col("score")).alias("start_ms"), (F.col("end_ms") + F.col("score")).alias("end_ms"))
    fixed = checks.extension(F.col("start_ms"), F.col("end_ms"), ext, F.col("start_ms"), F.col("start_ms") + 86_400_000)
    return c.select("cand_idx", fixed["needed"].alias("needed"))


@query(f"""with {CANDIDATES} select cand_idx, 1000 + score as start_ms, 1000 + 500 as end_ms from candidates where score < 500 and kind <> 'purchase'""")
def beat_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda a, z: F.struct(a.alias("start_sec"), z.alias("end_sec"))
    second = F.lit("0.5")
    c = candidates(spark, sf_dir).select("cand_idx", (F.col("kind") == "purchase").alias("is_intro_credits"), F.array(row((F.col("score") / 1000).cast("string"), second), row(F.lit("x"), second)).alias("beats"))
    kept = checks.without_intro(c).select("cand_idx", F.inline(checks.clean_beats(F.col("beats"), F.lit(1000))))
    return kept.select("cand_idx", "start_ms", "end_ms")


#: A user's first sign-up is the hook, the last purchase the payoff, the last click a build; half the users have a preview.
STORY = f"""{CANDIDATES}, g as (select source_id, min(case when kind = 'signup' then start_ms end) as h0, min(case when kind = 'signup' then start_ms end) + 50000000 as h1,
  max(case when kind = 'purchase' then start_ms end) as p0, max(case when kind = 'purchase' then start_ms end) + 40000000 as p1, max(case when kind = 'click' then start_ms end) as b0 from candidates group by 1),
m as (select *, coalesce(h0 < p1 and p0 < h1, false) as meet, h0 is not null and source_id % 2 = 0 as shown from g),
u as (select source_id, 0 as o, 'hook' as role, h0 as a, case when shown then h0 + 5000 else h1 end as z from m where h0 is not null
  union all select source_id, 1, 'build', b0, b0 + 1000 from m where b0 is not null
  union all select source_id, 2, 'build', h0, h1 from m where shown and not (meet and p0 is not null)
  union all select source_id, 3, 'payoff', case when shown and meet then least(h0, p0) else p0 end, case when shown and meet then greatest(h1, p1) else p1 end from m where p0 is not null)"""


@query(f"with {STORY} select source_id as variant_id, cast(row_number() over (partition by source_id order by o) - 1 as int) as clip_idx, role, cast(a as bigint) as start_ms, cast(z as bigint) as end_ms from u")
def story_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda pick, kind: pick(F.when(F.col("kind") == kind, F.col("start_ms")))
    g = candidates(spark, sf_dir).groupBy("source_id").agg(of(F.min, "signup").alias("h"), of(F.max, "purchase").alias("p"), of(F.max, "click").alias("b"))

    def span(c: str, length: int, index: int) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("start_ms"), (F.col(c) + length).alias("end_ms"), F.lit(0).cast(LONG).alias("chunk_index"), F.lit(index).cast(LONG).alias("candidate_index")))

    preview = F.when(F.col("source_id") % 2 == 0, span("h", 5000, 1))
    told = g.select(F.col("source_id").alias("variant_id"), span("h", 50_000_000, 0).alias("hook"), preview.alias("hook_preview"), span("p", 40_000_000, 2).alias("payoff"), F.filter(F.array(span("b", 1000, 3)), lambda b: b.isNotNull()).alias("build"))
    return clips.storyline_clips(told)


@query(f"""with {CANDIDATES} select cand_idx, cast(i as int) as piece_idx, start_ms + i * 1000 as start_ms, start_ms + i * 1000 + 500 as end_ms, case when i = 0 then kind else '' end as subtitle, case when i = 0 then 'd' else '' end as tts_draft
from (select *, unnest(range(0, 1 + score % 3)) as i from candidates)""")
def clip_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = lambda i: F.struct((F.col("start_ms") + i * 1000).alias("start_ms"), (F.col("start_ms") + i * 1000 + 500).alias("end_ms"))
    c = candidates(spark, sf_dir).select("cand_idx", F.col("kind").alias("subtitle"), F.lit("d").alias("tts_draft"), "start_ms", "end_ms", F.transform(F.sequence(F.lit(0).cast(LONG), F.col("score") % 3), piece).alias("pieces"))
    return clips.flatten_pieces(c)


@query(f"""with {CANDIDATES} select cand_idx, case kind when 'view' then 'calm' when 'click' then 'loud' else 'calm' end as voice from candidates""")
def label_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("cand_idx", clips.choose(F.col("kind"), {"view": "calm", "click": "loud"}, "view").alias("voice"))


# Ranking and keys.


@query("""with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place, count(*) over (partition by conv_id) as n from conversations) select conv_id, turn, cast(place as int) as place from n where place in (0, n // 2, n - 1)""")
def conv_first_middle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_middle_last(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn").withColumn("place", F.col("place").cast("int"))


@query("""with s as (select l_orderkey, l_linenumber, 0.3 * (l_quantity / 50) + 0.3 * l_discount + 0.3 * l_tax as score from lineitem)
select l_orderkey, arg_max(l_linenumber, (score, -l_linenumber)) as l_linenumber from s group by 1""")
def frame_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("area"), F.col("l_discount").alias("centre"), F.col("l_tax").alias("motion"))
    return ranking.speaker(faces, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""select source, arg_min(doc_id, (case lang when 'de' then 0 when 'en' then 2 else 4 end, doc_id)) as doc_id from documents group by 1""")
def preferred_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.preferred(table(spark, sf_dir, "documents"), ["source"], "doc_id", "lang", "de", "en")


@query("""with k as (select c_custkey, sha256(c_name) as key_hash, case when c_mktsegment = 'BUILDING' then 'ADMIN' else 'USER' end as role, c_nationkey as own, case when c_acctbal < 0 then 'FROZEN' else 'ACTIVE' end as status from customer)
select o_orderkey, case when role is null then 'unknown key' when status <> 'ACTIVE' then 'inactive key' when role <> 'ADMIN' and wanted <> own then 'not its channel' else 'ok' end as verdict,
  case when role is not null and status = 'ACTIVE' and (role = 'ADMIN' or wanted is null or wanted = own) then coalesce(wanted, own) end as channel
from (select o_orderkey, o_custkey, case when o_orderstatus <> 'F' then cast(o_custkey % 25 as int) end as wanted, sha256(case when o_orderpriority = '1-URGENT' then 'x' else (select c_name from customer where c_custkey = o_custkey) end) as h from orders) left join k on k.key_hash = h""")
def upload_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    role, status = F.when(F.col("c_mktsegment") == "BUILDING", "ADMIN").otherwise("USER"), F.when(F.col("c_acctbal") < 0, "FROZEN").otherwise("ACTIVE")
    keys = channels.key_hashes(c.select(F.col("c_name").alias("plain"), role.alias("role"), F.col("c_nationkey").alias("own"), status.alias("status")))
    orders = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    plain = F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise(F.col("c_name"))
    asked = orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 25).cast("int").alias("wanted"), F.sha2(plain, 256).alias("key_hash"))
    return channels.allowed_channel(asked, keys).select("o_orderkey", "verdict", "channel")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P' order by o_orderkey limit 1")
def order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.first_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus", "P", "o_orderkey").drop("o_orderstatus")


@query("""select l_orderkey, l_linenumber, case when not (l_quantity between 5 and 45) then 'length' when l_discount * -100 > -1 then 'peak' when l_tax > 0.05 then 'black' else 'ok' end as reason from lineitem""")
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = checks.output_reason(F.col("l_quantity"), 5, 45, F.col("l_discount") * -100, F.col("l_tax") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("""select event_id, case event_type when 'view' then 'unknown key view' else 'ok' end as reason from events""")
def editorial_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "avoid").otherwise("_note")
    document = F.concat(F.lit('{"'), key, F.lit('":[],"tone":"dry"}'))
    return table(spark, sf_dir, "events").select("event_id", checks.editorial_reason(document).alias("reason"))


_IMAGES = f"""{SPEECH_CLIPS}, spans as (select *, coalesce(sum(end_ms - start_ms) over (partition by source_id order by clip_idx rows between unbounded preceding and 1 preceding), 0) as edit_start,
  sum(end_ms - start_ms) over (partition by source_id) as total from clips where end_ms > start_ms),
met as (select s.source_id, s.seg_idx, s.speaker, s.end_ms as t, c.start_ms as c0, c.end_ms as c1, c.edit_start, c.total,
  row_number() over (partition by s.source_id, s.seg_idx order by case when c.start_ms <= s.end_ms and s.end_ms < c.end_ms then -1 else least(abs(s.end_ms - c.start_ms), abs(s.end_ms - c.end_ms)) end, c.clip_idx) as rn
  from segments s join spans c on s.source_id = c.source_id and s.end_ms >= c.start_ms - 500 and s.end_ms <= c.end_ms + 500),
put as (select *, edit_start + least(greatest(t - c0, 0), c1 - c0) as a from met where rn = 1)"""


@query(f"with {_IMAGES} select source_id, seg_idx, speaker as file, cast(a as bigint) as edit_s, cast(least(a + 4000, total) as bigint) as edit_e from put where least(a + 4000, total) - a >= 100")
def image_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = segments(spark, sf_dir).select("source_id", "seg_idx", F.col("speaker").alias("file"), F.col("end_ms").alias("source_ms"), F.lit(4000).cast(LONG).alias("dur_ms"))
    return clips.place_images(images, _speech_clips(spark, sf_dir).where("end_ms > start_ms"), BY, "seg_idx")[0]
