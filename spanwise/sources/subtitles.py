"""Subtitle files to timed rows and back: SRT, WebVTT, ASS/SSA and SAMI, by DataFrame operations.

Readers take rows (path, value) with a whole file each, as spark.read.text(wholetext=True) gives with
input_file_name(), and return (path, seg_idx, start_ms, end_ms, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every subtitle file of a path, each by its extension; another one is an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return parse(files)


def parse(files: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = F.when(kind.isin(*READERS), kind).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("path"))))
    marked = files.withColumn("_kind", known)
    parts = [reader(marked.where(F.col("_kind") == name).drop("_kind")) for name, reader in READERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ms(hours: Column, minutes: Column, seconds: Column, fraction: Column, unit: int) -> Column:
    number = lambda c: F.coalesce(F.when(c != "", c).cast("long"), F.lit(0))
    return number(hours) * 3_600_000 + number(minutes) * 60_000 + number(seconds) * 1000 + number(fraction) * unit


def _clean(text: Column) -> Column:
    """Tags and [notes] go; a leading (name) becomes `name: `, other brackets go."""
    text = F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}", "")
    text = F.regexp_replace(text, r"\[[^\]]*\]", "")
    text = F.regexp_replace(text, r"^\s*\(([^)]*)\)\s*", "$1: ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"\s+", " "))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("_at")
    good = rows.where((F.col("text") != "") & F.col("start_ms").isNotNull())
    return good.select("path", (F.row_number().over(order) - 1).alias("seg_idx"), "start_ms", "end_ms", "text")


def srt(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n[ \t]*\n")).alias("_at", "block"))
    at = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)[^\n]*"
    part = lambda i: F.regexp_extract("block", at, i)
    text = F.regexp_replace(F.regexp_extract("block", at + r"\n([\s\S]*)", 9), "\n", " ")
    timed = blocks.where(F.col("block").rlike(at)).select("path", "_at", _ms(*map(part, (1, 2, 3, 4)), 1).alias("start_ms"), _ms(*map(part, (5, 6, 7, 8)), 1).alias("end_ms"), _clean(text).alias("text"))
    return _numbered(timed)


def vtt(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), r"\n[ \t]*\n")).alias("_at", "block"))
    at = r"(?:(\d+):)?(\d+):(\d+)\.(\d+)\s*-->\s*(?:(\d+):)?(\d+):(\d+)\.(\d+)[^\n]*"
    part = lambda i: F.regexp_extract("block", at, i)
    said = F.regexp_replace(F.regexp_extract("block", at + r"\n([\s\S]*)", 9), "\n", " ")
    text = _clean(F.regexp_replace(said, r"<v\s+([^>]*)>", "$1: "))
    timed = blocks.where(F.col("block").rlike(at)).select("path", "_at", _ms(*map(part, (1, 2, 3, 4)), 1).alias("start_ms"), _ms(*map(part, (5, 6, 7, 8)), 1).alias("end_ms"), text.alias("text"))
    return _numbered(timed)


def ass(files: DataFrame) -> DataFrame:
    events = F.regexp_extract(F.regexp_replace("value", "\r", ""), r"(?i)\[Events\]\n((?:(?!\n\[)[\s\S])*)", 1)
    lines = files.select("path", F.posexplode(F.split(events, "\n")).alias("_at", "line")).where(F.col("line").startswith("Dialogue:"))
    fields = F.split(F.regexp_replace("line", "^Dialogue:", ""), ",", 10)
    time = lambda i: [F.regexp_extract(F.get(fields, F.lit(i)), r"(\d+):(\d+):(\d+)\.(\d+)", k) for k in (1, 2, 3, 4)]
    text = _clean(F.replace(F.replace(F.get(fields, F.lit(9)), F.lit("\\N"), F.lit(" ")), F.lit("\\n"), F.lit(" ")))
    timed = lines.where(F.size(fields) == 10).select("path", "_at", _ms(*time(1), 10).alias("start_ms"), _ms(*time(2), 10).alias("end_ms"), text.alias("text"))
    return _numbered(timed)


def smi(files: DataFrame, last: int = 3000) -> DataFrame:
    syncs = files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?i)<SYNC\s+Start=\d+>(?:(?!<SYNC)[\s\S])*"), F.lit(0))).alias("_at", "sync"))
    start = F.regexp_extract("sync", r"(?i)Start=(\d+)", 1).cast("long")
    who = F.lower(F.regexp_extract("sync", r"(?i)<P\s+Class=\"?(\w+)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("sync", r"<[^>]*>", " "), "&nbsp;", " "), r"\s+", " "))
    text = F.when(body == "", "").when(who.isin("", "krcc", "encc", "default"), body).otherwise(F.concat_ws(": ", who, body))
    order = Window.partitionBy("path").orderBy("_at")
    timed = syncs.withColumn("start_ms", start).withColumn("end_ms", F.coalesce(F.lead("start_ms").over(order), F.col("start_ms") + last))
    return _numbered(timed.select("path", "_at", "start_ms", "end_ms", text.alias("text")))


READERS = {"srt": srt, "vtt": vtt, "ass": ass, "ssa": ass, "smi": smi}


def as_srt(rows: DataFrame, by: str = "path") -> DataFrame:
    """One SRT file a group: (by, value)."""
    time = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.floor(c / 3_600_000), F.floor(c / 60_000) % 60, F.floor(c / 1000) % 60, c % 1000)
    block = F.concat_ws("\n", (F.col("seg_idx") + 1).cast("string"), F.concat_ws(" --> ", time(F.col("start_ms")), time(F.col("end_ms"))), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", block.alias("block"))))
    return rows.groupBy(by).agg(F.concat(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("value"))


def as_ass(rows: DataFrame, by: str = "path", style: str = "Default") -> DataFrame:
    """The event lines of one ASS file a group: (by, value)."""
    from ..functions.text import clock, escape_subtitle

    line = F.concat(F.lit("Dialogue: 0,"), clock(F.col("start_ms")), F.lit(","), clock(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), escape_subtitle(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda b: b["line"]), "\n").alias("value"))


def cue_key(text: Column, voice: Column, speed: Column, target_ms: Column) -> Column:
    """The cache key of a synthesised cue."""
    return F.sha1(F.concat_ws("\0", text, voice, speed, F.format_string("%.2f", target_ms / 1000)))


def cached_cues(cues: DataFrame, cache: DataFrame) -> DataFrame:
    """cues (text, voice, speed, target_ms) with their key, and the file of the cache (key, file) that has it."""
    keyed = cues.withColumn("key", cue_key(F.col("text"), F.col("voice"), F.col("speed"), F.col("target_ms")))
    return keyed.join(cache.select("key", "file"), "key", "left")


def salvage_json(answer: Column) -> Column:
    """struct(value, lost): the first complete JSON value of an answer, without its code fence, and how many characters
    behind it are left out. A value of brackets that never close is null."""
    bare = F.trim(F.regexp_replace(answer, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    start = F.regexp_extract(bare, r"(?s)[\[{].*", 0)
    # Strings first, so that brackets in them do not count; what is left is brackets and other text.
    parts = F.regexp_extract_all(start, F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+|"'), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part.isin("[", "{"), 1).when(part.isin("]", "}"), -1).otherwise(0)
        size = state["size"] + F.length(part)
        return F.when(state["done"], state).otherwise(F.struct(depth.alias("depth"), size.alias("size"), (depth == 0).alias("done")))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done")), step)
    whole = lambda f: F.struct(F.when(f["done"], F.left(start, f["size"])).alias("value"), F.when(f["done"], F.length(start) - f["size"]).alias("lost"))
    return F.transform(F.array(found), whole)[0]
