r"""ASS documents: styles, headers, four kinds of event lines, and files of lines as a data source of Spark.

Writers make rows (name, place, line), a file's lines in order, out of columns; no file is gathered into one row. save() sorts them by file and
the data source streams them out: a task holds one line. A task writes into a folder of its own attempt, and only what a committed task wrote
is moved to its place when the job commits, so a lost executor or a second attempt leaves no half file. Paths are those that pyarrow's file
systems know (file, hdfs, s3, gs); executors and driver must see the same one.

Times are integer milliseconds; a screen is 1080 x 1920.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import balanced_wrap, clock, subtitle_colour
from ..operators.intervals import edit_axis

WIDTH, HEIGHT, LINE_HEIGHT = 1080, 1920, 1.2

#: fonts' family names, presets of styles, genres' presets, strokes' colours and widths.
FAMILIES = {
    "Jalnan": "Jalnan 2 TTF", "여기어때 잘난체 2 TTF": "Jalnan 2 TTF", "JalnanGothic": "Jalnan Gothic TTF", "여기어때 잘난체 고딕 TTF": "Jalnan Gothic TTF",
    "mulmaru": "Mulmaru", "물마루": "Mulmaru", "Griun": "Griun PolFairness", "그리운 경찰공평체": "Griun PolFairness",
}
STYLE = "struct<font_name:string,font_size:int,primary_color:string,outline_color:string,outline:int,shadow:int,margin_v:int,bold:boolean,alignment:int,border_style:int,back_color:string>"
PLAIN = ("Malgun Gothic", 52, "&H00FFFFFF", "&H00000000", 2, 0, 480, False, 2, 1, "&H00000000")
PRESETS = {
    "hormozi": ("JalnanGothic", 70, "&H00FFFFFF", "&H00000000", 4, 0, 320, True, 2, 1, "&H00000000"),
    "kvar_yellow": ("JalnanGothic", 72, "&H0000FFFF", "&H00000000", 6, 2, 380, True, 2, 1, "&H00000000"),
    "drama_cine": ("mulmaru", 58, "&H00FFFFFF", "&H00202020", 1, 1, 180, False, 2, 1, "&H00000000"),
    "thriller_mono": ("JalnanGothic", 64, "&H00F5F5F5", "&H00000000", 3, 3, 320, True, 2, 1, "&H00000000"),
    "y2k_pink": ("Griun", 70, "&H00FFFFFF", "&H00B469FF", 5, 0, 380, False, 2, 1, "&H00000000"),
    "kakao_bubble": ("mulmaru", 56, "&H00000000", "&H00FFFFFF", 0, 0, 380, False, 2, 3, "&H00FFFFFF"),
}
GENRES = {
    "romance": "drama_cine", "romcom": "y2k_pink", "thriller": "thriller_mono", "variety": "kvar_yellow", "talk": "kakao_bubble", "docu": "hormozi", "vlog": "kvar_yellow", "other": "kvar_yellow",
}
DEFAULT_PRESET = "kvar_yellow"
STROKES = {"dark": ("&H00000000", 0.07), "white": ("&H00FFFFFF", 0.06), "none": ("&H00000000", 0.0)}
SPEAKER = r"(?:^|(?<=\s))(?:[가-힣][가-힣0-9]{0,4}|[A-Za-z][A-Za-z0-9]{0,9})\s*[:：]\s*"


def _fields(kind: str = STYLE) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in kind.removeprefix("struct<").removesuffix(">").split(",")]


def style(values: Sequence) -> Column:
    """A style as a struct of literals, in the order of STYLE."""
    return F.struct(*(F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(_fields(), values, strict=True)))


def chosen_preset(genre: Column, wanted: Column) -> Column:
    """The preset's name: the wanted one if there is such, else the genre's, else the default."""
    of_genre = F.try_element_at(F.create_map(*(F.lit(x) for pair in GENRES.items() for x in pair)), genre)
    return F.when(wanted.isin(*PRESETS), wanted).otherwise(F.coalesce(of_genre, F.lit(DEFAULT_PRESET)))


def chosen_style(genre: Column, wanted: Column, over: Column | None = None) -> Column:
    """The preset's style with whatever fields of the struct `over` (any of STYLE's) are not null laid over it."""
    known = F.create_map(*(x for name, values in PRESETS.items() for x in (F.lit(name), style(values))))
    base = F.element_at(known, chosen_preset(genre, wanted))
    return base if over is None else overlaid(base, over)


def overlaid(base: Column, *layers: Column) -> Column:
    """A style with the fields of each layer that are not null in place of its own, the last layer on top. A layer is a style, or null."""
    out = base
    for layer in layers:
        out = F.struct(*(F.coalesce(layer[name].cast(kind), out[name]).alias(name) for name, kind in _fields()))
    return out


def family(font: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair)), font), font)


def _style_line(name: str, s: Column, margin: int) -> Column:
    margin_v = F.when(s["margin_v"] >= 0, s["margin_v"]).otherwise(margin)
    bold = F.when(s["bold"], -1).otherwise(0)
    parts = (family(s["font_name"]), s["font_size"], s["primary_color"], s["outline_color"], s["back_color"], bold, F.lit(0), s["border_style"], s["outline"], s["shadow"], s["alignment"], F.lit(80), F.lit(80), margin_v, F.lit(0))
    return F.concat(F.lit(f"Style: {name},"), F.concat_ws(",", *(p.cast("string") for p in parts)))


def header(files: DataFrame, main: Column, narration: Column | None = None, name: str = "Default") -> DataFrame:
    """(name, place, line) of the head of each file of files (name and what the styles are made of); places are below 0."""
    start = ["[Script Info]", "ScriptType: v4.00+", f"PlayResX: {WIDTH}", f"PlayResY: {HEIGHT}", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
             "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, BackColour, Bold, Italic, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"]
    end = ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
    styles = [_style_line(name, main, 480)] + ([_style_line("TtsLine", narration, 300)] if narration is not None else [])
    lines = F.array(*map(F.lit, start), *styles, *map(F.lit, end))
    return files.select("name", F.posexplode(lines).alias("place", "line")).withColumn("place", (F.col("place") - 100).cast("long"))


def _said(text: Column) -> Column:
    """One line without names of speakers, trimmed first, as it is shown."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", ""), SPEAKER, "")


def _g(value: Column) -> Column:
    """A number as short as it can be written with six digits."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _bgr(colour: Column) -> Column:
    return F.concat(F.lit("&H"), F.substring(subtitle_colour(F.concat(F.lit("#"), F.ltrim(colour, F.lit("#")))), 5, 6), F.lit("&"))


def _tags(*parts: Column) -> Column:
    joined = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    return F.when(joined != "", F.concat(F.lit("{"), joined, F.lit("}"))).otherwise("")


def _tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit("\\" + kind), value.cast("string"))


def _event(layer: int, start: Column, end: Column, rest: Column) -> Column:
    return F.concat(F.lit(f"Dialogue: {layer},"), clock(start), F.lit(","), clock(end), F.lit(","), rest)


def clip_lines(clips: DataFrame) -> DataFrame:
    """Lines of clips (name, clip_idx, start_ms, end_ms, subtitle), one after the other from 0 on."""
    timed = edit_axis(clips, ["name"], ["clip_idx"])
    end = F.col("edit_start") + F.col("end_ms") - F.col("start_ms")
    line = _event(0, F.col("edit_start"), end, F.concat(F.lit("Default,,,,,, "), F.replace("subtitle", F.lit("\n"), F.lit(" "))))
    return timed.select("name", F.col("clip_idx").cast("long").alias("place"), line.alias("line"))


def segment_lines(segments: DataFrame, alignment: Column) -> DataFrame:
    """Lines of segments (name, seg_idx, times, text, and a struct `style` of size, y, color and rotate, or null), in two lines at most; what
    is blank without its speakers goes. alignment: of the file's style; a line's y is its margin where that is at the bottom, else a position."""
    own = F.col("style")
    bottom = alignment <= 3
    y = F.when(own["y"].isNotNull(), F.least(F.greatest(own["y"], F.lit(0.0)), F.lit(1.0)))
    margin = F.when(bottom & y.isNotNull(), F.greatest(F.lit(1), F.bround((1 - y) * HEIGHT, 0)).cast("int").cast("string")).otherwise("")
    tags = _tags(
        _tag("fs", F.bround(own["size"], 0).cast("int")), F.when(own["color"] != "", _tag("1c", _bgr(own["color"]))), F.when(own["rotate"] != 0, _tag("frz", _g(-own["rotate"]))),
        F.when(~bottom & y.isNotNull(), F.concat(F.lit(f"\\pos({WIDTH // 2},"), F.bround(y * HEIGHT, 0).cast("int").cast("string"), F.lit(")"))),
    )
    said = segments.withColumn("_said", _said(F.col("text"))).where("_said <> ''")
    line = _event(0, F.col("start_ms"), F.col("end_ms"), F.concat(F.lit("Default,,,,"), margin, F.lit(",, "), tags, balanced_wrap(F.col("_said"))))
    return said.select("name", F.col("seg_idx").cast("long").alias("place"), line.alias("line"))


def cue_lines(cues: DataFrame, main: Column | None = None, turn: float = 0.0, first: int = 1 << 40) -> DataFrame:
    """Lines of narration (name, cue_idx, times, text). Beside segments they have the style TtsLine; in a file of their own (main is its
    style) the style is Default, and turn degrees, clockwise, turn each about the middle of its block. Places start at `first`."""
    if not -180 <= turn <= 180:
        raise ValueError(f"turn is -180 to 180, not {turn}")
    said = cues.withColumn("_said", _said(F.col("text"))).where("_said <> ''").withColumn("_lines", balanced_wrap(F.col("_said")))
    tag = F.lit("")
    if main is not None and turn:
        rows = F.size(F.split("_lines", r"\\N", -1))
        margin = F.when(main["margin_v"] >= 0, main["margin_v"]).otherwise(480)
        middle = F.bround(F.lit(HEIGHT) - margin - rows * main["font_size"] * LINE_HEIGHT / 2, 0).cast("int")
        tag = F.concat(F.lit(f"{{\\frz{-turn:g}\\org({WIDTH // 2},"), middle.cast("string"), F.lit(")}"))
    line = _event(0, F.col("start_ms"), F.col("end_ms"), F.concat(F.lit("TtsLine" if main is None else "Default"), F.lit(",,,,,, "), tag, F.col("_lines")))
    return said.select("name", (F.col("cue_idx") + first).cast("long").alias("place"), line.alias("line"))


#: Style of files of free texts: a place holder, since every event brings its own.
TEXT_STYLE = ("Jalnan", 72, "&H00FFFFFF", "&H00000000", 4, 0, 1, True, 5, 1, "&H00000000")


def text_lines(texts: DataFrame, speed: float = 1.0) -> DataFrame:
    """Lines of free texts (name, idx, start_ms, end_ms, text, x, y, size, color, stroke, fx, rotate, font) around their middle, with their
    colours, stroke, turn and effect; times are divided by speed. Braces become wide ones, breaks \\N."""
    size, turn = F.bround("size", 0).cast("int"), -F.col("rotate")
    named = F.create_map(*(x for name, (colour, share) in STROKES.items() for x in (F.lit(name), F.struct(F.lit(colour).alias("colour"), F.lit(share).alias("share")))))
    stroke = F.coalesce(F.try_element_at(named, F.col("stroke")), F.element_at(named, F.lit("dark")))
    border = F.when(stroke["share"] > 0, F.greatest(F.lit(1), F.bround(size * stroke["share"], 0).cast("int"))).otherwise(0)
    swing = lambda a, z, by: F.concat(F.lit(f"\\t({a},{z},\\frz"), _g(turn + by if by else turn), F.lit(")"))
    effect = F.when(F.col("fx") == "pop", "\\fscx30\\fscy30\\t(0,140,\\fscx110\\fscy110)\\t(140,220,\\fscx100\\fscy100)").when(
        F.col("fx") == "shake", F.concat(swing(0, 70, 6), swing(70, 140, -6), swing(140, 210, 3), swing(210, 280, 0))
    )
    at = lambda c, most: F.bround(F.col(c) * most, 0).cast("int").cast("string")
    tags = _tags(
        F.concat(F.lit("\\an5\\pos("), at("x", WIDTH), F.lit(","), at("y", HEIGHT), F.lit(")")), _tag("fn", family(F.col("font"))), _tag("fs", size), _tag("1c", _bgr(F.col("color"))),
        _tag("3c", stroke["colour"]), _tag("bord", border), F.lit("\\shad0"), F.when(turn != 0, _tag("frz", _g(turn))), effect,
    )
    said = F.replace(F.replace(F.translate("text", "{}", "｛｝"), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\\N"))
    time = lambda c: F.floor(F.col(c) / speed)
    return texts.select("name", F.col("idx").cast("long").alias("place"), _event(2, time("start_ms"), time("end_ms"), F.concat(F.lit("Text,,0,0,0,,"), tags, said)).alias("line"))


def as_files(lines: DataFrame, name: str = "path") -> DataFrame:
    """(name, value) of small files, whole, with the mark of UTF-8 in front, for readers that take whole files."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy(F.col("name").alias(name)).agg(F.concat(F.lit("﻿"), F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")).alias("value"))


# Files of lines.


def save(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, place, line) as one file a name under path; a name is a relative path. append replaces files of the same name."""
    lines.sparkSession.dataSource.register(LineFiles)
    rows = lines.select(F.col("name").cast("string"), F.col("place").cast("long"), F.col("line").cast("string"))
    rows.repartition("name").sortWithinPartitions("name", "place").write.format("spanwise_lines").mode(mode).save(path)


def load(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(name, place, line) of the files under path whose name ends in suffix; a file is a task's, and a task holds one line."""
    spark.dataSource.register(LineFiles)
    return spark.read.format("spanwise_lines").option("suffix", suffix).load(path)


def _files(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _checked(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/") or name.startswith("_"):
        raise ValueError(f"no name of a file below the folder: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


@dataclass
class Files(InputPartition):
    names: list[str]


class LineFiles(DataSource):
    """Files of lines under a folder, as rows (name, place, line)."""

    @classmethod
    def name(cls) -> str:
        return "spanwise_lines"

    def schema(self) -> str:
        return "name string, place bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options["path"], self.options.get("suffix", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LineWriter(self.options["path"], overwrite)


class LineReader(DataSourceReader):
    #: Bytes of files that a task reads, unless one file alone is longer.
    SHARE = 1 << 26

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _files(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix) and "/_" not in f.path[len(root) :]]
        out, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if out[-1] and size + f.size > self.SHARE:
                out.append([])
                size = 0
            out[-1].append(f.path[len(root) + 1 :])
            size += f.size
        return [Files(names) for names in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        import io

        system, root = _files(self.path)
        for name in partition.names:
            with io.TextIOWrapper(system.open_input_stream(f"{root}/{name}"), "utf-8-sig", newline="\n") as lines:
                for place, line in enumerate(lines):
                    yield name, place, line.removesuffix("\n")


class LineWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = _files(self.path)
        folder, names, out = f"{root}/{self.job}/{uuid.uuid4().hex}", [], None
        try:
            for row in rows:
                if not names or row["name"] != names[-1]:
                    if out is not None:
                        out.close()
                    names.append(_checked(row["name"]))
                    system.create_dir(f"{folder}/{names[-1]}".rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(f"{folder}/{names[-1]}")
                    out.write(b"\xef\xbb\xbf")
                out.write(f"{row['line']}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _files(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            self._clear(system, root)
        for m in done:
            for name in m.names:
                system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._drop(system, root)

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        for f in system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
            if f.base_name != self.job:
                system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_files(self.path))

    def _drop(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")
