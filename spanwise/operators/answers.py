"""Answers of language models as rows: storylines, candidate moments, editorial guides. Each has a reason column that says ok or the first
thing that makes an answer unusable, and a reader that gives its rows with names made one, singles wrapped and defaults filled in.

A key counts as present with a null value too. Answers that do not parse are no objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import fill_index
from .contract import _FIELDS, _as, _given, _stripped, _truthy, number, said

#: Other names of the list of storylines, the types of a sequence, the keys of an answer on a chunk and of its moments.
STORY_LISTS = ("shorts", "proposals", "storyline_options", "options", "story_proposals", "stories", "story_list", "results", "output")
SEQUENCES = ("여정몰입형", "결과선공개형", "반전형", "시퀀스블록형")
ANSWER_KEYS = ("chunk_index", "chunk_start_sec", "chunk_end_sec", "summary", "candidate_moments")
MOMENT_KEYS = ("start_sec", "end_sec", "description")
GUIDE_LISTS = ("avoid", "rules", "prefer")
LINE = 20

_LIST = "array<variant>"


def _has(fields: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, F.lit(key)), F.lit(False))


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _story_list(v: Column, fields: Column) -> Column:
    """The answer's storylines under whatever name, a single one wrapped; null where there are none."""
    lists = [F.when(F.size(_at(v, f"$.{name}", _LIST)) > 0, _at(v, f"$.{name}", _LIST)) for name in STORY_LISTS]
    chosen = _at(v, "$.selected_storyline")
    single = F.when(F.size(_as(chosen, _FIELDS)) > 0, F.array(chosen))
    bare = F.when(_has(fields, "shorts_type") & (_has(fields, "storyline") | _has(fields, "start_sec")), F.array(v))
    return F.coalesce(_at(v, "$.storylines", _LIST), *lists, single, bare)


def _story_reason(sl: Column, i: Column) -> Column:
    """null, or what a storyline lacks."""
    fields = _as(sl, _FIELDS)
    told = lambda what: F.concat(F.lit("storyline "), i.cast("string"), F.lit(f": {what}"))
    kind = said(F.try_element_at(fields, F.lit("shorts_type")))
    lacks = F.when(fields.isNull() | ~_has(fields, "shorts_type"), told("no shorts_type")).when(~_has(fields, "score"), told("no score"))
    for key in ("start_sec", "end_sec"):
        lacks = lacks.when((kind == "highlight") & ~_has(fields, key), told(f"no {key}"))
    parts = F.try_element_at(fields, F.lit("storyline"))
    lacks = lacks.when((kind == "storytelling") & ~_truthy(parts), told("no storyline"))
    for role in ("hook", "payoff"):
        lacks = lacks.when((kind == "storytelling") & ~_has(_as(parts, _FIELDS), role), told(f"no {role}"))
        for key in ("start_sec", "end_sec"):
            lacks = lacks.when((kind == "storytelling") & ~_has(_at(parts, f"$.{role}", _FIELDS), key), told(f"no {role} {key}"))
    return lacks


def _parsed(docs: DataFrame, key: str, document: str) -> DataFrame:
    parsed = docs.select(key, F.try_parse_json(document).alias("_v"))
    return parsed.withColumn("_fields", _as(F.col("_v"), _FIELDS))


def _judged(docs: DataFrame, key: str, document: str) -> DataFrame:
    """(key, _v, _fields, _list, _reason) of answers with storylines. Each is found once: what passes a generator is not found anew where it is asked for."""
    d = _parsed(docs, key, document).select(key, F.explode(F.array(F.struct("_v", "_fields"))).alias("_p")).select(key, "_p.*")
    d = d.select(key, "_v", "_fields", F.explode(F.array(F.struct(_story_list(F.col("_v"), F.col("_fields")).alias("_list")))).alias("_p")).select(key, "_v", "_fields", "_p._list")
    lacking = F.transform("_list", _story_reason)
    first = F.try_element_at(F.filter(lacking, lambda r: r.isNotNull()), F.lit(1))
    reason = (
        F.when(F.col("_fields").isNull(), "no object").when(F.col("_list").isNull(), "no storylines").when(F.size("_list") == 0, "empty storylines")
        .when(~_has(F.col("_fields"), "title_txt") & ~_has(F.col("_fields"), "title_line1"), "no title").otherwise(F.coalesce(first, F.lit("ok")))
    )
    return d.select(key, "_v", "_fields", "_list", F.explode(F.array(reason)).alias("_reason"))


def story_reasons(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, reason) of every answer with storylines: ok, or the first thing that it lacks."""
    return _judged(docs, key, document).select(key, F.col("_reason").alias("reason"))


def stories(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, story_idx, shorts_type, score, sequence_type, title_line1, title_line2, ending_hook, story) of the storylines of answers that
    story_reasons() finds ok; story is the rest, a variant. A storyline without a title has the answer's: a title in one line is cut in two at
    LINE letters. An unknown sequence of a storytelling is the first."""
    d = _judged(docs, key, document).where("_reason = 'ok'")
    whole = F.coalesce(said(_at(F.col("_v"), "$.title_txt")), F.lit(""))
    cut = F.length(whole) > LINE
    one = F.when(_has(F.col("_fields"), "title_line1"), said(_at(F.col("_v"), "$.title_line1"))).otherwise(F.left(whole, F.lit(LINE)))
    two = F.when(_has(F.col("_fields"), "title_line1"), F.coalesce(said(_at(F.col("_v"), "$.title_line2")), F.lit(""))).otherwise(F.when(cut, F.substring(whole, LINE + 1, LINE)).otherwise(""))
    rows = d.select(key, one.alias("_one"), two.alias("_two"), F.posexplode("_list").alias("story_idx", "story")).withColumn("_own", _as(F.col("story"), _FIELDS))
    of = lambda name: said(F.try_element_at("_own", F.lit(name)))
    or_else = lambda name, other: F.when(_has(F.col("_own"), name), of(name)).otherwise(other).alias(name)
    kind = of("shorts_type")
    sequence = F.when((kind == "storytelling") & ~F.coalesce(of("sequence_type").isin(*SEQUENCES), F.lit(False)), SEQUENCES[0]).otherwise(of("sequence_type"))
    return rows.select(
        key, "story_idx", kind.alias("shorts_type"), number(F.try_element_at("_own", F.lit("score"))).alias("score"), sequence.alias("sequence_type"),
        or_else("title_line1", F.col("_one")), or_else("title_line2", F.col("_two")), or_else("ending_hook", F.lit("")), "story",
    )


def _moment_ok(m: Column) -> Column:
    fields = _as(m, _FIELDS)
    out = fields.isNotNull()
    for name in MOMENT_KEYS:
        out = out & _has(fields, name)
    return out


def moment_reasons(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, reason) of every answer on a chunk: ok, a key that it lacks, no list of moments, or none that can be used."""
    d = _parsed(docs, key, document).withColumn("_list", _at(F.col("_v"), "$.candidate_moments", _LIST))
    lacks = F.array_min(F.array_except(F.array(*map(F.lit, ANSWER_KEYS)), F.map_keys("_fields")))
    reason = (
        F.when(F.col("_fields").isNull(), "no object").when(lacks.isNotNull(), F.concat(F.lit("no "), lacks)).when(F.col("_list").isNull(), "no list")
        .when(~F.exists("_list", _moment_ok), "no usable moments").otherwise("ok")
    )
    return d.select(key, reason.alias("reason"))


def moments(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, moment_idx, candidate_index, start_ms, end_ms, description, reason, transcript) of the moments that have their keys; a candidate index
    that is no whole number becomes an unused one, above the largest of the answer, in order."""
    d = _parsed(docs, key, document)
    rows = d.select(key, F.posexplode(_at(F.col("_v"), "$.candidate_moments", _LIST)).alias("moment_idx", "_m")).withColumn("_own", _as(F.col("_m"), _FIELDS))
    of = lambda name: F.try_element_at("_own", F.lit(name))
    told = lambda name: F.when(_has(F.col("_own"), name), said(of(name))).otherwise("").alias(name)
    index = F.when(F.schema_of_variant(of("candidate_index")) == "BIGINT", _as(of("candidate_index"), "bigint")).alias("candidate_index")
    ms = lambda name, to: F.floor(number(of(name)) * 1000 + 0.5).cast("long").alias(to)
    every = rows.select(key, "moment_idx", index, ms("start_sec", "start_ms"), ms("end_sec", "end_ms"), told("description"), told("reason"), told("transcript"), _moment_ok(F.col("_m")).alias("_ok"))
    # Indices of moments that go count as used.
    top = every.groupBy(key).agg(F.max("candidate_index").alias("_top"))
    good = every.where("_ok").drop("_ok").join(top, key)
    filled = fill_index(good.withColumn("_none", F.col("candidate_index").isNull()), [key], "candidate_index", "moment_idx")
    own_top = F.coalesce(F.max(F.when(~F.col("_none"), F.col("candidate_index"))).over(Window.partitionBy(key)), F.lit(-1))
    shift = F.when(F.col("_none"), F.coalesce("_top", F.lit(-1)) - own_top).otherwise(0)
    return filled.withColumn("candidate_index", (F.col("candidate_index") + shift).cast("long")).drop("_top", "_none")


def guide_reason(document: Column) -> Column:
    """ok (blank texts too), or what is wrong with an editorial guide: no object, an unknown key (those of _ are notes), a list that is none of
    texts, a tone that is no text."""
    v = F.try_parse_json(document)
    fields = _as(v, _FIELDS)
    unknown = F.array_min(F.filter(F.map_keys(fields), lambda k: ~k.startswith("_") & ~k.isin(*GUIDE_LISTS, "tone")))
    texts = lambda c: F.coalesce(F.forall(_as(c, _LIST), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    reason = F.when(document.isNull() | document.rlike(r"^\s*$"), "ok").when(fields.isNull(), "no object").when(unknown.isNotNull(), F.concat(F.lit("unknown key "), unknown))
    for name in GUIDE_LISTS:
        own = F.try_element_at(fields, F.lit(name))
        reason = reason.when(_given(own) & ~texts(own), f"{name} is no list of texts")
    tone = F.try_element_at(fields, F.lit("tone"))
    return reason.when(_given(tone) & (F.schema_of_variant(tone) != "STRING"), "tone is no text").otherwise("ok")


def guide(document: Column) -> Column:
    """struct(avoid, rules, prefer, tone) of a guide that is ok, trimmed, without blank texts; null for what is empty, and for an empty guide."""
    fields = _as(F.try_parse_json(document), _FIELDS)

    def texts(name: str) -> Column:
        bare = F.filter(F.transform(_as(F.try_element_at(fields, F.lit(name)), "array<string>"), _stripped), lambda x: x != "")
        return F.when(F.size(bare) > 0, bare).alias(name)

    tone = _stripped(_as(F.try_element_at(fields, F.lit("tone")), "string"))
    made = F.struct(*map(texts, GUIDE_LISTS), F.when(tone != "", tone).alias("tone"))
    some = F.coalesce(*(made[n].cast("string") for n in (*GUIDE_LISTS, "tone"))).isNotNull()
    return F.when((guide_reason(document) == "ok") & some, made)
