"""Queries of injected functions, with plain functions in a model's place, of stages that resume, and of keyed inserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transcripts
from ..operators import channels, hooks
from ..operators.graph import _shared
from ..sources import stages
from .catalogue import BY, LONG, query
from .views import CANDIDATES, SEGMENTS, candidates, segments, table


def _hear(path: str) -> list[dict]:
    """Two segments a chunk; some chunks fail."""
    if len(path) % 7 == 0:
        raise OSError(path)
    half = len(path) // 2
    return [{"start_ms": 0, "end_ms": half * 10, "text": path[:half]}, {"start_ms": half * 10, "end_ms": len(path) * 10, "text": path[half:]}]


@query(f"""with {SEGMENTS}, c as (select *, length(text) // 2 as half from segments where length(text) % 7 <> 0)
select source_id, seg_idx as chunk_index, cast(0 as bigint) as seg_idx, start_ms, cast(start_ms + half * 10 as bigint) as end_ms, left(text, half) as text from c
union all select source_id, seg_idx, 1, start_ms + half * 10, start_ms + length(text) * 10, substr(text, half + 1) from c""")
def hook_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = segments(spark, sf_dir).select("source_id", F.col("seg_idx").alias("chunk_index"), F.col("text").alias("path"), F.col("start_ms").alias("r_start"))
    return hooks.transcribe(chunks, _hear)


def _half(text: str, target: int) -> str:
    if len(text) % 3 == 0:
        raise ValueError(text)
    return text[: target // 2] if len(text) % 3 == 1 else text


@query(f"""with {SEGMENTS}, t as (select source_id, seg_idx, text, 10 + seg_idx % 30 as most from segments)
select source_id, seg_idx, case when length(text) <= most then text when length(text) % 3 = 1 and trim(left(text, most // 2)) <> '' then trim(left(text, most // 2)) else rtrim(left(text, most), E'., \\t\\n') || '.' end as text from t""")
def hook_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("source_id", "seg_idx", hooks.shorten(F.col("text"), 10 + F.col("seg_idx") % 30, _half, " ").alias("text"))


def _chain(rows: list[dict]) -> list[dict]:
    """A row leads to the next by key; sources of an odd number of rows fail."""
    if len(rows) % 2:
        raise ValueError("odd")
    keys = sorted(r["cand_idx"] for r in rows)
    return [{"a": a, "b": b, "type": "continuous" if (b - a) % 2 else "contrast"} for a, b in zip(keys, keys[1:], strict=False)]


@query(f"""with {CANDIDATES}, n as (select source_id, cand_idx as a, lead(cand_idx) over (partition by source_id order by cand_idx) as b, count(*) over (partition by source_id) as n from candidates)
select source_id, cast(a as bigint) as a, cast(b as bigint) as b, case when (b - a) % 2 = 1 then 'continuous' else 'contrast' end as type from n where n % 2 = 0 and b is not null""")
def hook_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.relate(candidates(spark, sf_dir), BY, _chain, ["cand_idx", "kind"])


def _latest(rows: list[dict]) -> list[dict]:
    """The last two beats, and one that there is not; nothing for sources of over seventy rows."""
    return [] if len(rows) > 70 else [{"clip": -1, "beat": -1}, *({"clip": r["clip"], "beat": r["cand_idx"]} for r in rows[:-3:-1])]


@query(f"""with {CANDIDATES}, b as (select source_id, cast(cand_idx // 1000 as bigint) as clip, cand_idx, case kind when 'purchase' then 2 when 'view' then 0 else 1 end as grade, count(*) over (partition by source_id) as n,
  row_number() over (partition by source_id order by cand_idx // 1000 desc, cand_idx desc) as last from candidates)
select source_id, clip, cand_idx, cast(last - 1 as bigint) as place from b where n <= 70 and last <= 2
union all select source_id, clip, cand_idx, row_number() over (partition by source_id order by grade, clip, cand_idx) - 1 from b where n > 70 and grade < 2""")
def hook_beat_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "purchase", "core").when(F.col("kind") == "view", "droppable").otherwise("supporting")
    beats = candidates(spark, sf_dir).select("source_id", F.floor(F.col("cand_idx") / 1000).cast(LONG).alias("clip"), "cand_idx", kind.alias("importance"))
    return hooks.chosen_drops(beats, BY, "clip", "cand_idx", _latest)


@query(f"""with {CANDIDATES}, n as (select source_id, cand_idx, row_number() over (partition by source_id order by start_ms, cand_idx) - 1 as place, count(*) over (partition by source_id) as n from candidates)
select source_id, cand_idx, case when place = 0 then 'hook' when place = n - 1 then 'payoff' else 'build' end as role from n where place in (0, n // 3, 2 * n // 3, n - 1)""")
def hook_fallback_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = candidates(spark, sf_dir).withColumn("told", F.struct("start_ms", "cand_idx"))
    return hooks.fallback_story(one, BY, "told").select("source_id", "cand_idx", "role")


@query("select user_id, cast(sum(floor(value)) as bigint) * 2 + 1 as total from events where event_type <> 'error' group by 1")
def stages_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages, written to the shared folder; then the last one is run again from what the second wrote."""
    steps = [
        ("good", lambda df: df.where("event_type <> 'error'").select("user_id", F.floor("value").cast(LONG).alias("v"))),
        ("sums", lambda df: df.groupBy("user_id").agg(F.sum("v").alias("v"))),
        ("totals", lambda df: df.select("user_id", (F.col("v") * 2 + 1).alias("total"))),
    ]
    folder, events = f"{_shared(spark).rstrip('/')}/stages-{uuid.uuid4().hex}", table(spark, sf_dir, "events")
    stages.run(spark, events, steps[:2], folder)
    return stages.run(spark, events, steps, folder, "totals")


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then 'new ' || c_name else c_name end as name from customer where c_custkey % 5 <> 0
union all select c_custkey, 'new ' || c_name from customer where c_custkey % 10 = 0""")
def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return channels.upsert(c.where("id % 5 <> 0"), c.where("id % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")), "id")


@query("select cast(doc_id % 50 as bigint) as episode, doc_id, source from documents where doc_id % 50 <= 12")
def doc_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.episodes(table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).cast(LONG).alias("episode"), "doc_id", "source"), 12)


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'k' || c_nationkey else c_name end as name from customer")
def dim_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("name"))
    return channels.restore(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), known, ["id"], ["name"])
