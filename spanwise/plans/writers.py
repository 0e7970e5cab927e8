"""Queries of subtitle documents: styles, event lines, files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.graph import _shared
from ..sources import ass
from .catalogue import LONG, query
from .views import SEGMENTS, segments, table

_quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower()
PRESETS = "presets(preset, font, size, primary_c, outline_c, outline, shadow, margin_v, bold, alignment, border, back_c) as (values " + ", ".join(f"({_quoted(k)}, {', '.join(map(_quoted, v))})" for k, v in ass.PRESETS.items()) + ")"
GENRES = "genres(genre, of_genre) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in ass.GENRES.items()) + ")"
FAMILIES = "families(font, family) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in ass.FAMILIES.items()) + ")"

_WORDS = r"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
_FILLED = r"regexp_extract_all(" + _WORDS + r", '([^\n]{{1,' || {w} || '}}|[^ ]+)(?: |$)', 1)"


def _wrapped(t: str) -> str:
    """The text in two lines at most, in SQL."""
    first, again = _FILLED.format(t=t, w="15"), _FILLED.format(t=t, w=f"greatest(15, (length({t}) + 1) // 2 + 2)")
    return rf"array_to_string(case when len({first}) > 2 then ({again})[1:2] else {first} end, '\N')"


def _clock(ms: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000 // 10)"


#: A conversation's file: its style by genre, sometimes wanted or overlaid; its turns as lines with styles of their own.
LOOKS = f"""{SEGMENTS}, {PRESETS}, {GENRES}, {FAMILIES},
files as (select distinct source_id, source_id || '.ass' as name, case source_id % 9 when 0 then 'romance' when 1 then 'romcom' when 2 then 'thriller' when 3 then 'variety' when 4 then 'talk' when 5 then 'docu' when 6 then 'vlog' when 7 then 'other' end as genre,
  case source_id % 6 when 0 then 'hormozi' when 1 then 'auto' when 2 then 'drama_cine' end as wanted, case when source_id % 4 = 0 then 40 + source_id % 50 end as over_size from segments),
looks as (select f.*, coalesce(w.preset, of_genre, 'kvar_yellow') as chosen from files f left join presets w on w.preset = wanted left join genres using (genre)),
styled as (select l.source_id, l.name, chosen, p.*, cast(coalesce(over_size, p.size) as int) as font_size, family from looks l join presets p on p.preset = chosen join families using (font))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_id")
    genre = F.get(F.array(*map(F.lit, ("romance", "romcom", "thriller", "variety", "talk", "docu", "vlog", "other"))), (n % 9).cast("int"))
    wanted = F.when(n % 6 == 0, "hormozi").when(n % 6 == 1, "auto").when(n % 6 == 2, "drama_cine")
    over = F.struct(F.when(n % 4 == 0, 40 + n % 50).cast("int").alias("font_size"))
    over = F.from_json(F.to_json(over), ass.STYLE)
    files = segments(spark, sf_dir).select("source_id").distinct()
    return files.select("source_id", F.concat(n.cast("string"), F.lit(".ass")).alias("name"), ass.chosen_preset(genre, wanted).alias("preset"), ass.chosen_style(genre, wanted, over).alias("look"))


@query(f"with {LOOKS} select source_id, chosen as preset, font as font_name, font_size, primary_c as primary_color, cast(margin_v as int) as margin_v, bold, cast(border as int) as border_style from styled")
def ass_style_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("source_id", "preset", "look.font_name", "look.font_size", "look.primary_color", "look.margin_v", "look.bold", "look.border_style")


_TAGS = r"""case when seg_idx % 3 = 0 then '{' || '\fs' || (40 + seg_idx) || case when seg_idx % 2 = 0 then '\1c&HCC' || 'BBAA&' else '' end || case when seg_idx % 5 <> 2 then '\frz' || (2 - seg_idx % 5) else '' end || '}' else '' end"""
_MARGIN = "case when seg_idx % 3 = 0 and seg_idx % 4 <> 3 then greatest(1, cast(round_even((1 - seg_idx % 4 / 3.0) * 1920, 0) as int))::varchar else '' end"
EVENTS = rf"""{LOOKS}, events as (select s.source_id || '.ass' as name, seg_idx, 'Dialogue: 0,' || {_clock('start_ms')} || ',' || {_clock('end_ms')} || ',Default,,,,' || {_MARGIN} || ',, ' || {_TAGS} || {_wrapped("trim(text)")} as line
  from segments s where trim(text) <> '')"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_idx")
    look = F.struct((40.0 + i).alias("size"), F.when(i % 4 != 3, i % 4 / 3.0).alias("y"), F.when(i % 2 == 0, "#aaBBcc").alias("color"), (i % 5 - 2).cast("double").alias("rotate"))
    said = segments(spark, sf_dir).select(F.concat(F.col("source_id").cast("string"), F.lit(".ass")).alias("name"), "seg_idx", "start_ms", "end_ms", "text", F.when(i % 3 == 0, look).alias("style"))
    return ass.segment_lines(said, F.lit(2))


@query(f"with {EVENTS} select name, cast(seg_idx as bigint) as place, line from events")
def ass_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


_HEAD = ["[Script Info]", "ScriptType: v4.00+", "PlayResX: 1080", "PlayResY: 1920", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
         "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, BackColour, Bold, Italic, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"]
_TAIL = ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]


@query(f"""with {EVENTS}, heads as (select name, unnest([{', '.join(map(repr, _HEAD))}, 'Style: Default,' || family || ',' || font_size || ',' || primary_c || ',' || outline_c || ',' || back_c || ',' || case when bold then -1 else 0 end || ',0,' || border || ',' || outline || ',' || shadow || ',' || alignment || ',80,80,' || margin_v || ',0', {', '.join(map(repr, _TAIL))}]) as line,
  unnest(range(12)) - 100 as k from styled),
every as (select name, k, line from heads union all by name select name, seg_idx as k, line from events)
select name, cast(row_number() over (partition by name order by k) - 1 as bigint) as place, line from every""")
def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a conversation, written to the shared folder by the data source and read back by it."""
    lines = ass.header(_files(spark, sf_dir), F.col("look")).unionByName(_lines(spark, sf_dir))
    folder = f"{_shared(spark).rstrip('/')}/ass-{uuid.uuid4().hex}"
    ass.save(lines, folder)
    return ass.load(spark, folder, ".ass")


@query("""select p_partkey, case lower(c) when 'white' then '&H00FFFFFF' when 'black' then '&H00000000' when 'yellow' then '&H0000FFFF' when 'red' then '&H000000FF' when 'green' then '&H0000FF00' when 'blue' then '&H00FF0000' when 'skyblue' then '&H00EBCE87' when 'pink' then '&H00B469FF' end as colour,
  case when p_size % 5 = 0 then 30.0::double else p_partkey / (p_size % 5)::double end as rate, replace(replace(replace(p_type, ':', '\\:'), '[', '\\['), '''', '’') as drawn from (
  select *, case p_partkey % 9 when 0 then 'white' when 1 then 'BLACK' when 2 then 'yellow' when 3 then 'red' when 4 then 'green' when 5 then 'Blue' when 6 then 'skyblue' when 7 then 'pink' else 'mauve' end as c from part)""")
def part_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    colour = F.get(F.array(*map(F.lit, ("white", "BLACK", "yellow", "red", "green", "Blue", "skyblue", "pink", "mauve"))), (n % 9).cast("int"))
    rate = F.concat_ws("/", n.cast("string"), (F.col("p_size") % 5).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.any_colour(colour).alias("colour"), tx.frame_rate(rate).alias("rate"), tx.escape_drawtext(F.col("p_type")).alias("drawn"))


@query(f"""with {SEGMENTS} select source_id, cast(seg_idx as bigint) as seg_idx, {_wrapped("text")} as two_lines from segments where trim(text) <> ''""")
def turn_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(F.trim("text") != "").select("source_id", F.col("seg_idx").cast(LONG).alias("seg_idx"), tx.balanced_wrap(F.col("text")).alias("two_lines"))
