"""Text functions on columns: normalising, repetition and script tests, wrapping, names, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Without [a~b] or [a-b] time marks, and of the rest only digits, Latin letters and Hangul."""
    marks = r"(?U)\[\s*\d+(?:\.\d+)?\s*[~-]\s*\d+(?:\.\d+)?\s*\]"
    # Alnum is ASCII's, in one look-up; as ranges, letters and digits take several times as long.
    return F.regexp_replace(F.regexp_replace(text, marks, " "), r"[^\p{Alnum}\x{AC00}-\x{D7A3}]+", "")


def strip_speaker(text: Column) -> Column:
    """Without `name: ` prefixes at the start or after a blank."""
    return F.trim(F.regexp_replace(text, r"(^|\s)[^\s:]{1,20}:\s", "$1"))


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", "")


def repeats(text: Column, average: Column | None = None) -> Column:
    """Any stretch of 2 to 20 characters, not all blank, three times in a row (blanks count as one); or far longer than the average."""
    squeezed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    again = squeezed.rlike(r"(?s)(.{2,20})\1{2}")
    return again if average is None else again | ((F.length(text) > 5 * average) & (F.length(text) > 80))


def script_counts(text: Column) -> dict[str, Column]:
    """Letters by script: Hangul, Latin, other."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    native = F.length(F.regexp_replace(text, r"[^\x{AC00}-\x{D7A3}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))
    return {"native": native, "latin": latin, "foreign": letters - native - latin}


def escapes_language(text: Column, share: float = 0.5) -> Column:
    """Whether at least `share` of the letters is of a foreign script."""
    c = script_counts(text)
    total = c["native"] + c["latin"] + c["foreign"]
    return (total > 0) & (c["foreign"] >= share * total)


def error_rate(reference: Column, other: Column, per: int = 1) -> Column:
    """Edit distance of normalised texts over the reference's length, times `per`; null for an empty reference. Multiplied before
    it is divided, so that a whole number of edits per `per` characters is whole."""
    a, b = normalise(reference), normalise(other)
    return F.when(F.length(a) > 0, F.levenshtein(a, b) * F.lit(per).cast("long") / F.length(a))


def cut_title(text: Column, most: int = 20) -> Column:
    """At most `most` characters, cut at a blank where there is one."""
    words = F.regexp_extract(text, rf"^.{{0,{most}}}(?=\s|$)", 0)
    return F.when(F.length(text) <= most, text).otherwise(F.when(F.length(words) > 0, F.rtrim(words)).otherwise(F.left(text, F.lit(most))))


def wrap(text: Column, width: int) -> Column:
    """Array of lines of at most `width` characters, filled word by word; longer words have their own."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.regexp_extract_all(words, F.lit(rf"([^\n]{{1,{width}}}|[^ ]+)(?: |$)"), F.lit(1))


def alike(a: Column, b: Column) -> Column:
    """Share of a's distinct characters that b has too."""
    x, y = (F.array_remove(F.array_distinct(F.split(c, "")), "") for c in (a, b))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(1.0)


def video_id(url: Column) -> Column:
    """The 11-character id in a watch or short URL, else the first 16 digits of the URL's SHA-256."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).otherwise(F.left(F.sha2(url, 256), F.lit(16)))


def safe_name(name: Column) -> Column:
    """ASCII letters, digits, dots, dashes; else 12 digits of the name's MD5."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(kept != "", kept).otherwise(F.left(F.md5(name), F.lit(12)))


def subtitle_colour(colour: Column) -> Column:
    """#RRGGBB as &H00BBGGRR."""
    part = lambda at: F.upper(F.substring(colour, at, 2))
    return F.concat(F.lit("&H00"), part(6), part(4), part(2))


def escape_subtitle(text: Column) -> Column:
    r"""Braces and line breaks of a subtitle: { and } become parentheses, a break becomes \N."""
    return F.replace(F.translate(text, "{}", "()"), F.lit("\n"), F.lit("\\N"))


def clock(ms: Column) -> Column:
    """H:MM:SS.cc, truncated."""
    cs = F.floor(ms / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


#: Names of colours that a subtitle may be given in.
COLOURS = {"white": "FFFFFF", "black": "000000", "yellow": "FFFF00", "red": "FF0000", "green": "00FF00", "blue": "0000FF", "skyblue": "87CEEB", "pink": "FF69B4"}


def any_colour(value: Column) -> Column:
    """&H00BBGGRR of a name, of #RRGGBB or RRGGBB; a value that starts with &H stays; null where it is none of these."""
    bare = F.trim(F.coalesce(value, F.lit("")))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair)), F.lower(bare))
    digits = F.regexp_extract(F.coalesce(named, bare), r"^#*([0-9A-Fa-f]{6})$", 1)
    return F.when(F.lower(bare).startswith("&h"), bare).when(digits != "", subtitle_colour(F.concat(F.lit("#"), digits)))


def balanced_wrap(text: Column, width: int = 15, most: int = 2) -> Column:
    r"""The text in at most `most` lines, joined by \N: filled to `width` characters, or, if that takes more lines, to an even share of
    the text and two more, of which the first `most` lines are taken."""
    words = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    even = F.greatest(F.lit(width), F.floor((F.length(text) + most - 1) / most) + 2).cast("string")
    pattern = F.concat(F.lit("([^\\n]{1,"), even, F.lit("}|[^ ]+)(?: |$)"))
    lines = wrap(words, width)
    again = F.slice(F.regexp_extract_all(words, pattern, F.lit(1)), 1, most)
    return F.array_join(F.when(F.size(lines) > most, again).otherwise(lines), "\\N")


def frame_rate(rate: Column) -> Column:
    """Frames a second of `a/b`; 30 where it is no such fraction or b is 0."""
    parts = F.split(rate, "/", -1)
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when((F.size(parts) == 2) & (b != 0) & a.isNotNull(), a / b).otherwise(30.0)


def escape_drawtext(text: Column) -> Column:
    """Text for a drawtext filter: backslashes, colons and brackets escaped, an apostrophe as the typographic one."""
    return F.replace(F.regexp_replace(text, r"([\\:\[\]])", r"\\$1"), F.lit("'"), F.lit("’"))
