"""The contract of override documents as a table of rules, and what an accepted document changes.

A document (a JSON text) is walked into nodes: itself, its title, its lists and their items, a subtitle's style. Each
node meets the rules of its section, a small broadcast table, so checking shuffles nothing; the first broken
rule of a document is the smallest by (stage, position of the item, step). Nothing is ignored in silence: unknown keys
are broken rules too, and what the newest stamp alone may hold is refused under an older one.

Numbers are JSON numbers, booleans or texts that write a decimal number; other than finite ones are no numbers. A key
whose value is null counts as absent, but for known keys and a clip's role. Documents that do not parse, or that have a
key twice, are no objects. Times in the results are integer milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import best_overlap, nearest

#: Fixed values of the contract: stamps, roles, keys, files, colours, choices and bounds.
STAMPS = ("edit_overrides/v1", "edit_overrides/v2", "edit_overrides/v3")
NEWEST = STAMPS[-1]
ROLES = ("hook", "build", "payoff")
STYLE_KEYS = ("size", "y", "color", "rotate")
IMAGE_KEYS = ("file", "source_time_sec", "duration_sec", "x", "y", "w", "layer", "rotate")
TEXT_KEYS = ("text", "source_time_sec", "duration_sec", "x", "y", "size", "color", "stroke", "fx", "rotate", "font")
SEGMENT_KEYS = ("text", "start_sec", "end_sec")
STROKES = ("dark", "none", "white")
EFFECTS = ("none", "pop", "shake")
FONTS = ("Jalnan", "JalnanGothic", "mulmaru", "Griun")
COLOUR = r"^#[0-9A-Fa-f]{6}$"
IMAGE_FILE = r"(?i)[^/]\.(png|jpg|jpeg)/*$"
OUTSIDE_FOLDER = r"^[/~]|(^|/)\.\.(/|$)"
MOST_SEGMENTS, MOST_LETTERS, SIZES, TURN = 20, 60, (12.0, 400.0), 180.0
TEXT_DEFAULTS = {"size": 72, "color": "#FFFFFF", "stroke": "dark", "fx": "none", "rotate": 0.0, "font": "Jalnan"}
DEFAULT_VOICE, DEFAULT_SPEED, DEFAULT_CUE_MS, NEAR_MS = "ko_female", "normal", 3000, 1000

#: In the order in which a document is judged; a style is judged with its subtitle.
SECTIONS = ("document", "title", "title.segments", "title.segments[]", "title.segments~", "clips", "clips[]", "subtitles", "subtitles[]", "tts", "tts[]", "images", "images[]", "texts", "texts[]")
STYLE = "subtitles[].style"
LISTS = ("clips", "subtitles", "tts", "images", "texts")

_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]*$"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_FIELDS = "map<string,variant>"


def _rules() -> list[tuple]:
    """(section, stage, step, key, check, low, high, allowed, reason)."""
    out: list[tuple] = []

    def add(section: str, key: str, check: str, reason: str, low: float | None = None, high: float | None = None, allowed: Sequence[str] = ()) -> None:
        stage = SECTIONS.index("subtitles[]" if section == STYLE else section)
        out.append((section, stage, len(out), key, check, low, high, list(allowed), reason))

    def number(section: str, key: str, low: float | None = None, high: float | None = None, above: float | None = None, needed: bool = True) -> None:
        add(section, key, "number" if needed else "number or none", f"{key} is no number")
        if above is not None:
            add(section, key, "above", f"{key} is not above {above:g}", above)
        elif low is not None:
            add(section, key, "range", f"{key} is out of range", low, high)

    def span(section: str) -> None:
        for key in ("start_sec", "end_sec"):
            add(section, key, "number", f"{key} is no number")
        add(section, "start_sec", "range", "start_sec is out of range", 0.0)
        add(section, "start_sec", "before", "times are turned", allowed=["end_sec"])

    def turn(section: str) -> None:
        number(section, "rotate", -TURN, TURN, needed=False)

    def window(section: str) -> None:
        number(section, "source_time_sec", 0.0)
        number(section, "duration_sec", above=0.0)

    add("document", "", "object", "is no object")
    add("document", "schema", "member", "schema is unknown", allowed=STAMPS)
    add("title", "", "object", "is no object")
    add("title", "top_title", "text or none", "top_title is blank")
    add("title.segments", "", "newest", "needs the newest schema")
    add("title.segments", "", "filled list", "is no list with rows")
    add("title.segments", "", "most", f"has over {MOST_SEGMENTS} rows", high=float(MOST_SEGMENTS))
    add("title.segments[]", "", "object", "is no object")
    add("title.segments[]", "", "known", "has an unknown key", allowed=SEGMENT_KEYS)
    span("title.segments[]")
    add("title.segments[]", "text", "text", "text is blank")
    add("title.segments~", "", "apart", "rows overlap")
    add("clips", "", "filled list", "is no list with rows")
    add("clips[]", "", "object", "is no object")
    span("clips[]")
    add("clips[]", "role", "member or absent", "role is unknown", allowed=ROLES)
    add("subtitles", "", "filled list", "is no list with rows")
    add("subtitles[]", "", "object", "is no object")
    span("subtitles[]")
    add("subtitles[]", "text", "text", "text is blank")
    for key in ("source_time_sec", "style"):
        add("subtitles[]", key, "newest if given", "anchor and style need the newest schema")
    number("subtitles[]", "source_time_sec", 0.0, needed=False)
    add(STYLE, "", "filled object", "style is no object with keys")
    add(STYLE, "", "known", "style has an unknown key", allowed=STYLE_KEYS)
    number(STYLE, "size", above=0.0, needed=False)
    number(STYLE, "y", 0.0, 1.0, needed=False)
    add(STYLE, "color", "pattern", "color is no #RRGGBB", allowed=[COLOUR])
    turn(STYLE)
    add("tts", "", "list", "is no list")
    add("tts[]", "", "object", "is no object")
    number("tts[]", "source_time_sec", 0.0)
    add("tts[]", "text", "text", "text is blank")
    number("tts[]", "duration_sec", above=0.0, needed=False)
    add("images", "", "newest", "needs the newest schema")
    add("images", "", "filled list", "is no list with rows")
    add("images[]", "", "object", "is no object")
    add("images[]", "", "known", "has an unknown key", allowed=IMAGE_KEYS)
    add("images[]", "file", "filled text", "file is blank")
    add("images[]", "file", "no pattern", "file leaves the folder", allowed=[OUTSIDE_FOLDER])
    add("images[]", "file", "pattern", "file is no png or jpg", allowed=[IMAGE_FILE])
    window("images[]")
    for key in ("x", "y", "w"):
        number("images[]", key, 0.0, 1.0)
    add("images[]", "layer", "integer or none", "layer is no integer")
    turn("images[]")
    add("texts", "", "newest", "needs the newest schema")
    add("texts", "", "filled list", "is no list with rows")
    add("texts[]", "", "object", "is no object")
    add("texts[]", "", "known", "has an unknown key", allowed=TEXT_KEYS)
    add("texts[]", "text", "filled text", "text is blank")
    add("texts[]", "text", "longest", f"text is over {MOST_LETTERS} letters", high=float(MOST_LETTERS))
    window("texts[]")
    for key in ("x", "y"):
        number("texts[]", key, 0.0, 1.0)
    number("texts[]", "size", *SIZES, needed=False)
    add("texts[]", "color", "pattern", "color is no #RRGGBB", allowed=[COLOUR])
    for key, names in (("stroke", STROKES), ("fx", EFFECTS), ("font", FONTS)):
        add("texts[]", key, "member or none", f"{key} is unknown", allowed=names)
    turn("texts[]")
    return out


RULES = _rules()
SECTION = "_section string, keys array<string>, rules array<struct<stage: int, step: int, key: string, slot: int, check: string, low: double, high: double, allowed: array<string>, reason: string>>"


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _given(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def said(value: Column) -> Column:
    """A value as text; null where it is absent."""
    return F.when(_given(value), F.coalesce(_as(value, "string"), F.to_json(value)))


def number(value: Column, kind: Column | None = None, text: Column | None = None) -> Column:
    """A value as a finite double, else null. kind and text: its schema_of_variant and said(), where they are known."""
    kind = F.schema_of_variant(value) if kind is None else kind
    text = said(value) if text is None else text
    # A number's text is read, as each cast of a variant costs far more than one of a text.
    of = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when((kind != "STRING") | text.rlike(_DECIMAL), F.trim(text).try_cast("double"))
    return F.when(F.abs(of) < float("inf"), of)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


def _truthy(value: Column) -> Column:
    """Whether a value is given and neither false, zero, an empty text, list nor object."""
    filled = F.coalesce(F.size(_as(value, "array<variant>")), F.size(_as(value, _FIELDS)), F.lit(1)) > 0
    return _given(value) & filled & ~F.coalesce((_as(value, "string") == "") | (number(value) == 0) & (F.schema_of_variant(value) != "STRING"), F.lit(False))


def nodes(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, newest, section, pos, item, fields): what rules look at. pos is the item's place, -1 beside lists."""
    at = lambda value, path: F.try_variant_get(value, path, "variant")
    parsed = docs.select(F.col(key), F.try_parse_json(document).alias("_v"))
    top = parsed.select(key, "_v", *(at(F.col("_v"), f"$.{name}").alias(f"_{name}") for name in ("schema", "title", *LISTS)))
    top = top.withColumn("_segments", at(F.col("_title"), "$.segments"))
    node = lambda section, pos, item: F.struct(F.lit(section).alias("section"), F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.alias("pos"), item.alias("item"))
    none = F.array().cast("array<struct<section:string,pos:int,item:variant>>")
    one = lambda section, item, when: F.when(when, F.array(node(section, -1, item))).otherwise(none)

    def rows(section: str, items: Column) -> Column:
        return F.coalesce(F.transform(_as(items, "array<variant>"), lambda item, i: node(section, i.cast("int"), item)), none)

    found = [F.array(node("document", -1, F.col("_v"))), one("title", F.col("_title"), _truthy(F.col("_title")))]
    for name, items in (("title.segments", F.col("_segments")), *((name, F.col(f"_{name}")) for name in LISTS)):
        found += [one(name, items, _given(items)), rows(f"{name}[]", items)]
    found.append(one("title.segments~", F.col("_segments"), _given(F.col("_segments"))))
    styled = F.transform(_as(F.col("_subtitles"), "array<variant>"), lambda item, i: node(STYLE, i.cast("int"), at(item, "$.style")))
    found.append(F.coalesce(F.filter(styled, lambda r: _given(r["item"])), none))
    newest = F.coalesce(_as(F.col("_schema"), "string") == NEWEST, F.lit(False))
    every = top.select(key, newest.alias("newest"), F.inline(F.concat(*found)))
    return every.withColumn("fields", _as(F.col("item"), _FIELDS))


def _apart(items: Column) -> Column:
    """Whether windows in order of time overlap none before."""
    spans = F.transform(items, lambda r, i: F.struct(number(F.try_variant_get(r, "$.start_sec", "variant")).alias("s"), number(F.try_variant_get(r, "$.end_sec", "variant")).alias("e"), i.alias("i")))
    spans = F.array_sort(F.filter(spans, lambda r: r["s"].isNotNull() & r["e"].isNotNull()))
    met = F.zip_with(spans, F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), lambda a, b: b["s"] < a["e"] - 1e-9)
    return ~F.coalesce(F.exists(met, lambda x: x), F.lit(False))


def _facts(keys: Column, fields: Column) -> Column:
    """What the checks ask of the values of keys, found once a node: struct(value, kind, number, text) for each key."""
    kinds = F.transform(F.transform(keys, lambda k: F.try_element_at(fields, k)), lambda v: F.struct(v.alias("value"), F.schema_of_variant(v).alias("kind"), said(v).alias("text")))
    return F.transform(kinds, lambda f: F.struct(f["value"].alias("value"), f["kind"].alias("kind"), number(f["value"], f["kind"], f["text"]).alias("number"), f["text"].alias("text")))


def _broken(rule: Column) -> Column:
    """Whether a node breaks a rule; its item, newest, fields, size and facts are columns."""
    fields, item, newest, size, allowed = F.col("fields"), F.col("item"), F.col("newest"), F.col("size"), rule["allowed"]
    fact = F.get(F.col("facts"), rule["slot"])
    value, kind, num, text = fact["value"], fact["kind"], fact["number"], fact["text"]
    low, high = F.coalesce(rule["low"], F.lit(float("-inf"))), F.coalesce(rule["high"], F.lit(float("inf")))
    pattern = F.try_element_at(allowed, F.lit(1))
    known = F.coalesce((kind == "STRING") & F.array_contains(allowed, text), F.lit(False))
    present = F.coalesce(F.map_contains_key(fields, rule["key"]), F.lit(False))
    given = F.coalesce(kind != "VOID", F.lit(False))
    checks = {
        "number": num.isNull(),
        "number or none": given & num.isNull(),
        "range": ~((num >= low) & (num <= high)),
        "above": num <= low,
        "before": num >= number(F.try_element_at(fields, pattern)),
        "text": ~present | text.rlike(_BLANK),
        "text or none": text.rlike(_BLANK),
        "filled text": ~_truthy(value) | text.rlike(_BLANK),
        "longest": F.length(text) > high,
        "member": ~known,
        "member or absent": present & ~known,
        "member or none": given & ~known,
        "pattern": given & ~F.rlike(text, pattern),
        "no pattern": F.rlike(_stripped(text), pattern),
        "integer or none": given & ~kind.isin("BIGINT", "BOOLEAN"),
        "newest if given": given & ~newest,
        "known": F.size(F.array_except(F.map_keys(fields), allowed)) > 0,
        "object": fields.isNull(),
        "filled object": F.coalesce(F.size(fields), F.lit(0)) <= 0,
        "newest": ~newest,
        "list": size.isNull(),
        "filled list": F.coalesce(size, F.lit(0)) == 0,
        "most": size > high,
        "apart": ~_apart(_as(item, "array<variant>")),
    }
    out = F.lit(False)
    for name, broken in reversed(checks.items()):
        out = F.when(rule["check"] == name, broken).otherwise(out)
    return F.coalesce(out, F.lit(False))


def violations(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, section, pos, reason, stage, step) of every rule that a document breaks. Rules of an item's keys need an object."""
    # A row a section, with its keys and its rules: a node meets them at once and is no row a rule.
    by: dict[str, tuple[list, list]] = {}
    for section_, stage, step, name, check, low, high, allowed, reason in RULES:
        keys, rules = by.setdefault(section_, ([], []))
        if name and name not in keys:
            keys.append(name)
        rules.append((stage, step, name, keys.index(name) if name else -1, check, low, high, allowed, reason))
    sections = docs.sparkSession.createDataFrame([(name, *told) for name, told in by.items()], SECTION)
    met = nodes(docs, key, document).join(F.broadcast(sections), F.col("section") == F.col("_section"))
    met = met.withColumns({"facts": _facts(F.col("keys"), F.col("fields")), "size": F.size(_as(F.col("item"), "array<variant>"))})
    broken = F.filter("rules", lambda r: (F.col("fields").isNotNull() | (r["key"] == "")) & _broken(r))
    return met.select(key, "section", "pos", F.explode(broken).alias("_told")).select(key, "section", "pos", "_told.reason", "_told.stage", "_told.step")


def first_violation(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, reason) of every document (key is unique): ok, or section, place in it and reason of the first broken rule."""
    where = F.when(F.col("pos") >= 0, F.regexp_replace("section", r"\[\]", F.concat(F.lit("["), F.col("pos"), F.lit("]")))).otherwise(F.regexp_replace("section", "~", ""))
    told = violations(docs, key, document).select(key, F.struct("stage", "pos", "step", F.concat_ws(": ", where, F.col("reason")).alias("reason")).alias("_first"))
    first = told.groupBy(key).agg(F.min("_first").alias("_first"))
    return docs.select(key).join(first, key, "left").select(key, F.coalesce("_first.reason", F.lit("ok")).alias("reason"))


def accepted(docs: DataFrame, key: str, document: str = "document", strict: bool = True) -> DataFrame:
    """docs that keep the contract. strict: one that does not fails the job with its first broken rule; else it goes."""
    judged = docs.join(first_violation(docs, key, document).withColumnRenamed("reason", "_reason"), key)
    good = F.col("_reason") == "ok"
    if strict:
        good = good | F.raise_error(F.concat_ws(": ", F.col(key).cast("string"), F.col("_reason"))).cast("boolean")
    return judged.where(good).drop("_reason")


# What an accepted document changes.


def _ms(value: Column) -> Column:
    return F.floor(number(value) * 1000 + 0.5).cast("long")


def section(docs: DataFrame, key: str, name: str, document: str = "document") -> DataFrame:
    """(key, idx, fields) of the items of a list of the documents."""
    return nodes(docs, key, document).where(F.col("section") == f"{name}[]").select(key, F.col("pos").alias("idx"), "fields")


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def clips(docs: DataFrame, olds: DataFrame, key: str, carried: Sequence[str] = (), document: str = "document") -> DataFrame:
    """(key, clip_idx, role, start_ms, end_ms, subtitle, use_original_audio, pacing_note, chunk_index, candidate_index, carried..)
    of documents that have clips, all of them anew. What a document cannot say comes from the old clip (key, clip_idx and these
    columns) that a new one overlaps most, the first of equals; where there is none, stays the default."""
    told = section(docs, key, "clips", document).select(
        key, F.col("idx").alias("clip_idx"), F.coalesce(said(_field("role")), F.lit(ROLES[1])).alias("role"), _ms(_field("start_sec")).alias("start_ms"), _ms(_field("end_sec")).alias("end_ms"),
        said(_field("subtitle")).alias("_subtitle"), _truthy(_field("use_original_audio")).alias("_audio"), _given(_field("use_original_audio")).alias("_heard"), said(_field("pacing_note")).alias("_note"),
    )
    taken = ("subtitle", "use_original_audio", "pacing_note", "chunk_index", "candidate_index", *carried)
    old = olds.select(key, F.col("clip_idx").alias("_old"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), *taken)
    met = best_overlap(told, old, [key], "clip_idx", "_old", taken)
    return met.select(
        key, "clip_idx", "role", "start_ms", "end_ms", F.coalesce("_subtitle", "subtitle", F.lit("")).alias("subtitle"),
        F.when(F.col("_heard"), F.col("_audio")).otherwise(F.coalesce("use_original_audio", F.lit(True))).alias("use_original_audio"),
        F.coalesce(F.when(F.col("_note") != "", F.col("_note")), "pacing_note", F.lit("")).alias("pacing_note"),
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), F.coalesce("candidate_index", F.lit(-1)).alias("candidate_index"), *carried,
    )


def variants(olds: DataFrame, docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """olds (key, variant_id, title and more) with the title of the key's document in its variant 0, and `pinned`: whether
    the document gives that variant clips, which no automatic correction may move then."""
    parsed = docs.select(key, F.try_parse_json(document).alias("_v"))
    title = _stripped(said(F.try_variant_get("_v", "$.title.top_title", "variant")))
    some = F.coalesce(F.size(F.try_variant_get("_v", "$.clips", "array<variant>")), F.lit(0)) > 0
    told = parsed.select(key, F.when(title != "", title).alias("_title"), some.alias("_pinned"), F.lit(0).alias("variant_id"))
    joined = olds.join(told, [key, "variant_id"], "left")
    return joined.withColumns({"title": F.coalesce("_title", "title"), "pinned": F.coalesce("_pinned", F.lit(False))}).select(*olds.columns, "pinned")


def subtitles(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, idx, start_ms, end_ms, text, source_ms, style) of the documents' subtitles; style is null where none is given."""
    style = _as(_field("style"), _FIELDS)
    of = lambda name: F.try_element_at(style, F.lit(name))
    drawn = F.struct(number(of("size")).alias("size"), number(of("y")).alias("y"), said(of("color")).alias("color"), number(of("rotate")).alias("rotate"))
    return section(docs, key, "subtitles", document).select(
        key, "idx", _ms(_field("start_sec")).alias("start_ms"), _ms(_field("end_sec")).alias("end_ms"), _stripped(said(_field("text"))).alias("text"),
        _ms(_field("source_time_sec")).alias("source_ms"), F.when(F.size(style) > 0, drawn).alias("style"),
    )


def texts(docs: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, idx, text, source_ms, dur_ms, x, y, size, color, stroke, fx, rotate, font) with the contract's defaults filled in."""
    or_default = lambda value, name: F.coalesce(value, F.lit(TEXT_DEFAULTS[name])).alias(name)
    return section(docs, key, "texts", document).select(
        key, "idx", said(_field("text")).alias("text"), _ms(_field("source_time_sec")).alias("source_ms"), _ms(_field("duration_sec")).alias("dur_ms"), number(_field("x")).alias("x"), number(_field("y")).alias("y"),
        or_default(F.bround(number(_field("size")), 0).cast("int"), "size"), or_default(F.upper(said(_field("color"))), "color"), or_default(said(_field("stroke")), "stroke"),
        or_default(said(_field("fx")), "fx"), or_default(number(_field("rotate")), "rotate"), or_default(said(_field("font")), "font"),
    )


def cues(docs: DataFrame, olds: DataFrame, key: str, document: str = "document") -> DataFrame:
    """(key, place, text, source_ms, dur_ms, voice, speed, chunk_index, candidate_index): the documents' narration, in order of its
    place in the source. What is not given comes from the nearest old cue (key, old_idx and these columns) up to NEAR_MS away, of
    equally near ones the last. A document whose list is empty has no rows: its narration is gone."""
    told = section(docs, key, "tts", document).select(
        key, "idx", _stripped(said(_field("text"))).alias("text"), _ms(_field("source_time_sec")).alias("source_ms"), _ms(_field("duration_sec")).alias("_dur"),
        F.when(_truthy(_field("voice")), said(_field("voice"))).alias("_voice"), F.when(_truthy(_field("speed")), said(_field("speed"))).alias("_speed"),
    )
    kept = ("dur_ms", "voice", "speed", "chunk_index", "candidate_index")
    old = olds.where("source_ms is not null").select(key, "old_idx", F.col("source_ms").alias("_old_ms"), *(F.col(c).alias(f"_o_{c}") for c in kept))
    met = nearest(told, old.select(key, "old_idx", "_old_ms"), [key], "idx", "source_ms", "_old_ms", "old_idx", NEAR_MS).drop("_old_ms").join(old.drop("_old_ms"), [key, "old_idx"], "left")
    filled = lambda *names: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in names[:-1]), F.lit(names[-1]))
    place = F.row_number().over(Window.partitionBy(key).orderBy("source_ms", "idx")) - 1
    return met.select(
        key, place.alias("place"), "text", "source_ms", F.coalesce("_dur", "_o_dur_ms", F.lit(DEFAULT_CUE_MS)).cast("long").alias("dur_ms"), filled("_voice", "_o_voice", DEFAULT_VOICE).alias("voice"),
        filled("_speed", "_o_speed", DEFAULT_SPEED).alias("speed"), F.coalesce("_o_chunk_index", F.lit(-1)).alias("chunk_index"), F.coalesce("_o_candidate_index", F.lit(-1)).alias("candidate_index"),
    )
