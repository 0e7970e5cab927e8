"""Transcripts: notation rules, sentence splits, key terms, credits, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import clusters, last_cluster

#: Words to their usual notation, and what may follow a number between ten and ninety-nine.
NOTATION = {
    "에스케이텔레콤": "SK텔레콤", "에스케이 텔레콤": "SK텔레콤", "엔씨소프트": "NC소프트", "엔씨 소프트": "NC소프트",
    "씨티오": "CTO", "시티오": "CTO", "아이티 업계": "IT업계", "아이티업계": "IT업계",
}
DIGITS = "일이삼사오육칠팔구"
UNITS = ("년", "년대", "년간", "개월", "개", "명", "원", "월", "일", "시간", "분", "초", "번", "살", "층", "위", "배", "대", "주년", "퍼센트", "킬로", "미터", "인분", "회")
PARTICLES = ("은", "는", "이", "가", "을", "를", "에", "의", "도", "만", "과", "와", "으로", "로", "부터", "까지", "이나", "나", "씩", "째", "에서", "이다", "다")


def restore_notation(text: Column, rules: dict[str, str] | None = None) -> Column:
    """struct(text, used): whole tokens (between blanks), and runs of them, replaced by rule, rules of more tokens first;
    and a number word of ten to ninety-nine with a unit, and a particle maybe, in digits. used: `from→to` for each."""
    rules = NOTATION if rules is None else rules
    longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
    number = f"^([{DIGITS}]?)십([{DIGITS}]?)({longest(UNITS)})({longest(PARTICLES)})?$"

    sizes: dict[int, dict[str, str]] = {}
    for old, new in rules.items():
        sizes.setdefault(len(old.split(" ")), {})[old] = new
    hit = lambda new, n, old: F.struct(new.alias("new"), F.lit(n).alias("n"), F.array(F.concat_ws("→", old, new)).alias("used"))

    def found(tokens: Column, token: Column, i: Column) -> Column:
        digit = lambda k: F.instr(F.lit(DIGITS), F.regexp_extract(token, number, k))
        tens = F.when(F.regexp_extract(token, number, 1) == "", 1).otherwise(digit(1))
        ones = F.when(F.regexp_extract(token, number, 2) == "", 0).otherwise(digit(2))
        figures = F.concat((tens * 10 + ones).cast("string"), F.regexp_extract(token, number, 3), F.regexp_extract(token, number, 4))
        chosen = F.when(token.contains("십") & token.rlike(number), hit(figures, 1, token)).otherwise(F.struct(token.alias("new"), F.lit(1).alias("n"), F.array().cast("array<string>").alias("used")))
        for size, known in sorted(sizes.items()):  # rules of more tokens are asked first
            said = token if size == 1 else F.array_join(F.slice(tokens, i + 1, size), " ")
            table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
            chosen = F.when(said.isin(*known), hit(F.try_element_at(table, said), size, said)).otherwise(chosen)
        return chosen

    def scanned(tokens: Column) -> Column:
        # What stands at a token is found once, by itself; where a rule may take several tokens, a walk leaves out those taken.
        hits = F.transform(tokens, lambda token, i: found(tokens, token, i))
        if max(sizes, default=1) > 1:
            start = F.struct(F.array().cast("array<struct<new:string,n:int,used:array<string>>>").alias("kept"), F.lit(0).alias("left"))
            walk = lambda state, h: F.when(state["left"] > 0, F.struct(state["kept"].alias("kept"), (state["left"] - 1).alias("left"))).otherwise(F.struct(F.concat(state["kept"], F.array(h)).alias("kept"), (h["n"] - 1).alias("left")))
            hits = F.aggregate(hits, start, walk, lambda state: state["kept"])
        return F.transform(F.array(hits), lambda w: F.struct(F.array_join(w["new"], " ").alias("text"), F.flatten(w["used"]).alias("used")))[0]

    return F.when(text.isNotNull(), F.transform(F.array(F.split(text, " ", -1)), scanned)[0])


def rules_used(rows: DataFrame, used: str = "used") -> DataFrame:
    """(rule, n): how often each notation rule was used."""
    return rows.select(F.explode(used).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def split_sentences(words: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Words to sentences: each ends with a word that ends in . ! or ?"""
    w = Window.partitionBy(*by).orderBy(order)
    ends = F.sum(F.when(F.col("text").rlike(r"[.!?]$"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("sentence", F.coalesce(ends, F.lit(0)))
    said = F.array_sort(F.collect_list(F.struct(order, "text")))["text"]
    return marked.groupBy(*by, "sentence").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(said, " ").alias("text"))


def confidence(words: DataFrame, by: Sequence[str], logprob: str = "logprob") -> DataFrame:
    """Mean log probability of each group's words; 0.0 where none has one."""
    return words.groupBy(*by).agg(F.coalesce(F.avg(logprob), F.lit(0.0)).alias("confidence"))


def key_terms(terms: DataFrame, term: str, order: str, most: int = 1000) -> DataFrame:
    """Distinct terms in first order: up to 50 characters and 5 words, without brackets or backslashes."""
    bare = terms.select(F.trim(term).alias("term"), order)
    good = bare.where((F.col("term") != "") & (F.length("term") <= 50) & (F.size(F.split("term", r"\s+")) <= 5) & ~F.col("term").rlike(r"[<>{}\[\]\\]"))
    first = good.groupBy("term").agg(F.min(order).alias(order))
    return first.orderBy(order, "term").limit(most)


def count_literals(text: Column, literals: Sequence[str]) -> list[Column]:
    return [F.regexp_count(text, F.lit(rf"\Q{x}\E")).alias(f"n_{i}") for i, x in enumerate(literals)]


#: What credits say, and how long after the start and before the end of a source it is looked for.
CREDIT_PATTERNS = (
    "감독", "연출", "극본", "각본", "출연", "제작", "제공", "기획", "협찬", "조연출", "촬영", "편집", "음악", "미술", "조명", "동시녹음", "작가", "PD", "프로듀서",
    "directed by", "produced by", "written by", "cast", "executive producer", "director", "screenplay", "cinematography", "editor", "music by", "CAST", "END", "CREDITS", "THE END",
)
SCAN_MS, CLUSTER_MS, LEAST_HITS = 120_000, 30_000, 3


def credits(segments: DataFrame, lengths: DataFrame, by: Sequence[str], patterns: Sequence[str] = CREDIT_PATTERNS, scan: int = SCAN_MS, within: int = CLUSTER_MS, least: int = LEAST_HITS, order: str = "seg_idx") -> DataFrame:
    """(by, intro_end, credits_start) of every source of lengths (by, duration_ms): lines with a credit pattern in the first `scan` give the
    intro's end by clusters(), those in the last `scan` the credits' start by last_cluster(); else 0 and the duration."""
    hit = F.lower("text").rlike("|".join(rf"\Q{p.lower()}\E" for p in patterns))
    hits = segments.where(hit).select(*by, order, "start_ms", "end_ms").join(lengths.select(*by, "duration_ms"), list(by))
    first = hits.where((F.col("end_ms") > 0) & (F.col("start_ms") < F.least(F.lit(scan), F.col("duration_ms"))))
    last = hits.where((F.col("end_ms") > F.greatest(F.lit(0), F.col("duration_ms") - scan)) & (F.col("start_ms") < F.col("duration_ms")))
    intro = clusters(first, by, "start_ms", "end_ms", within, least).select(*by, F.col("end_ms").alias("_intro"))
    outro = last_cluster(last, by, "start_ms", "end_ms", within, least, order).select(*by, F.col("start_ms").alias("_outro"))
    joined = lengths.select(*by, "duration_ms").join(intro, list(by), "left").join(outro, list(by), "left")
    return joined.select(*by, F.coalesce("_intro", F.lit(0)).cast("long").alias("intro_end"), F.coalesce("_outro", "duration_ms").cast("long").alias("credits_start"))


def exclusion_zones(sources: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, intro_end, credits_start, method, confidence_pct) from what is set by hand, seen and read, the widest of them; what leaves nothing
    between falls back to what is set by hand. sources: by, duration_ms, skip_intro, skip_credits (0 for none), seen_intro, seen_credits (null
    for none), read_intro and read_credits of credits(). Null zones and method `impossible` where the skipped parts leave nothing."""
    zero, total = F.lit(0), F.col("duration_ms")
    set_start, set_end = F.col("skip_intro"), total - F.col("skip_credits")
    seen_start, seen_end = F.when(F.col("seen_intro") > 0, F.col("seen_intro")), F.when(F.col("seen_credits") < total, F.col("seen_credits"))
    start = F.greatest(set_start, F.coalesce(seen_start, zero), F.coalesce("read_intro", zero))
    end = F.least(set_end, F.coalesce(seen_end, total), F.coalesce("read_credits", total))
    sound = start < end
    seen = sound & (seen_start.isNotNull() | seen_end.isNotNull())
    read = sound & ((F.coalesce("read_intro", zero) > 0) | (F.coalesce("read_credits", total) < total))
    by_hand = (F.col("skip_intro") > 0) | (F.col("skip_credits") > 0)
    used = seen.cast("int") + read.cast("int") + by_hand.cast("int")
    method = F.when(used == 0, "none").when(used > 1, "hybrid").when(seen, "video").when(read, "srt").otherwise("config")
    sure = F.when(used == 0, 100).when(used > 1, F.when(seen, 90).otherwise(80)).when(seen, 85).when(read, 70).otherwise(100)
    able = F.col("skip_intro") + F.col("skip_credits") < total
    told = lambda c: F.when(able, c)
    return sources.select(
        *by, told(F.when(sound, start).otherwise(set_start)).cast("long").alias("intro_end"), told(F.when(sound, end).otherwise(set_end)).cast("long").alias("credits_start"),
        F.when(able, method).otherwise("impossible").alias("method"), told(sure).cast("long").alias("confidence_pct"),
    )


def summary(rows: DataFrame, by: Sequence[str], order: str, most: int = 8, width: int = 100) -> DataFrame:
    """The first `most` texts of each group, cut to `width`, as numbered lines."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    lines = rows.withColumn("_n", place).where(F.col("_n") <= most).withColumn("_line", F.format_string("%d. %s", "_n", F.left("text", F.lit(width))))
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_line")))["_line"]
    return lines.groupBy(*by).agg(F.array_join(ordered, "\n").alias("summary"))


def episodes(rows: DataFrame, upto: int) -> DataFrame:
    return rows.where(F.col("episode") <= upto).orderBy("episode")
