"""ASS documents against lines written plainly, styles, and files of lines written and read back."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanwise.functions import text as tx
from spanwise.sources import ass, subtitles

SPEAKER = re.compile(r"(?:^|(?<=\s))(?:[가-힣][가-힣0-9]{0,4}|[A-Za-z][A-Za-z0-9]{0,9})\s*[:：]\s*")


def clock(ms):
    return f"{ms // 3_600_000:d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000 // 10:02d}"


def filled(text, width):
    lines, now = [], ""
    for word in text.split():
        if now and len(now) + 1 + len(word) > width:
            lines.append(now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return lines + [now] if now else lines or [text]


def wrapped(text):
    lines = filled(text, 15)
    if len(lines) > 2:
        lines = filled(text, max(15, (len(text) + 1) // 2 + 2))[:2]
    return "\\N".join(lines)


def said(text):
    return SPEAKER.sub("", text.replace("\n", " ").strip())


def bgr(colour):
    c = colour.lstrip("#")
    return f"&H{c[4:6]}{c[2:4]}{c[:2]}&".upper()


TEXTS = ["one two three four", "a\nb  c", "지민: 안녕하세요 여러분 오늘은 정말 긴 문장을 나누어 봅니다 그렇죠", "x: ", " ", "supercalifragilisticexpialidocious word", "Ann: hello Bob: you", "w " * 40 + "end", "그래\t요", "a{b}c"]


def test_wrap_in_two_lines(spark):
    rnd = random.Random(2)
    texts = TEXTS + [" ".join("".join(rnd.choice("abcd가") for _ in range(rnd.randint(1, 18))) for _ in range(rnd.randint(1, 14))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts if t.strip()], "t string")
    assert [(r.t, r.w) for r in frame.select("t", tx.balanced_wrap(F.col("t")).alias("w")).collect()] == [(t, wrapped(t)) for t in texts if t.strip()]


def test_segment_and_cue_lines(spark):
    rnd = random.Random(3)
    styles = [None, (64.0, 0.8, "#ffDD00", -15.5), (None, None, None, 0.0), (12.5, 1.0, None, 33.3333333), (None, 0.0, "#010203", None)]
    rows = [("a", i, i * 1234, i * 1234 + 999, t, rnd.choice(styles)) for i, t in enumerate(TEXTS * 4)]
    frame = spark.createDataFrame(rows, "name string, seg_idx int, start_ms long, end_ms long, text string, style struct<size:double,y:double,color:string,rotate:double>")
    for alignment in (2, 8):
        want = {}
        for _, i, s, e, t, style in rows:
            size, y, colour, turn = style or (None,) * 4
            tags = f"\\fs{round(size)}" if size is not None else ""
            tags += f"\\1c{bgr(colour)}" if colour else ""
            tags += f"\\frz{-turn:g}" if turn else ""
            margin = ""
            if y is not None and alignment <= 3:
                margin = str(max(1, round((1 - y) * 1920)))
            elif y is not None:
                tags += f"\\pos(540,{round(y * 1920)})"
            if said(t):
                want[i] = f"Dialogue: 0,{clock(s)},{clock(e)},Default,,,,{margin},, {'{' + tags + '}' if tags else ''}{wrapped(said(t))}"
        assert {r.place: r.line for r in ass.segment_lines(frame, F.lit(alignment)).collect()} == want
    cues = frame.select("name", F.col("seg_idx").alias("cue_idx"), "start_ms", "end_ms", "text")
    beside = {r.place: r.line for r in ass.cue_lines(cues, first=0).collect()}
    assert beside == {i: f"Dialogue: 0,{clock(s)},{clock(e)},TtsLine,,,,,, {wrapped(said(t))}" for _, i, s, e, t, _ in rows if said(t)}
    main = ass.style(ass.PRESETS["drama_cine"])
    alone = {r.place: r.line for r in ass.cue_lines(cues, main, 12.5, 0).collect()}
    for _, i, s, e, t, _ in rows:
        if said(t):
            middle = round(1920 - 180 - (wrapped(said(t)).count("\\N") + 1) * 58 * 1.2 / 2)
            assert alone[i] == f"Dialogue: 0,{clock(s)},{clock(e)},Default,,,,,, {{\\frz-12.5\\org(540,{middle})}}{wrapped(said(t))}"
    with pytest.raises(ValueError):
        ass.cue_lines(cues, main, 181)


def test_clip_and_text_lines(spark):
    clips = spark.createDataFrame([("a", 1, 5000, 8000, "two\nlines"), ("a", 0, 700, 2700, "one"), ("b", 0, 0, 1, "")], "name string, clip_idx int, start_ms long, end_ms long, subtitle string")
    assert {(r.name, r.place, r.line) for r in ass.clip_lines(clips).collect()} == {
        ("a", 0, "Dialogue: 0,0:00:00.00,0:00:02.00,Default,,,,,, one"), ("a", 1, "Dialogue: 0,0:00:02.00,0:00:05.00,Default,,,,,, two lines"), ("b", 0, "Dialogue: 0,0:00:00.00,0:00:00.00,Default,,,,,, "),
    }
    rows = [("t", 0, 1000, 3000, "a{b}\r\nc", 0.5, 0.25, 72, "#FFDD00", "dark", "none", 0.0, "Jalnan"), ("t", 1, 0, 999, "x", 0.1, 1.0, 12, "#010203", "none", "pop", 30.0, "mulmaru"), ("t", 2, 0, 10, "y", 0.0, 0.0, 100, "#ffffff", "white", "shake", -7.5, "Other"), ("t", 3, 0, 10, "z", 0.0, 0.0, 100, "#ffffff", "odd", "shake", 0.0, "Griun")]
    frame = spark.createDataFrame(rows, "name string, idx int, start_ms long, end_ms long, text string, x double, y double, size int, color string, stroke string, fx string, rotate double, font string")
    got = {r.place: r.line for r in ass.text_lines(frame, 2.0).collect()}
    assert got == {
        0: "Dialogue: 2,0:00:00.50,0:00:01.50,Text,,0,0,0,,{\\an5\\pos(540,480)\\fnJalnan 2 TTF\\fs72\\1c&H00DDFF&\\3c&H00000000\\bord5\\shad0}a｛b｝\\Nc",
        1: "Dialogue: 2,0:00:00.00,0:00:00.49,Text,,0,0,0,,{\\an5\\pos(108,1920)\\fnMulmaru\\fs12\\1c&H030201&\\3c&H00000000\\bord0\\shad0\\frz-30\\fscx30\\fscy30\\t(0,140,\\fscx110\\fscy110)\\t(140,220,\\fscx100\\fscy100)}x",
        2: "Dialogue: 2,0:00:00.00,0:00:00.00,Text,,0,0,0,,{\\an5\\pos(0,0)\\fnOther\\fs100\\1c&HFFFFFF&\\3c&H00FFFFFF\\bord6\\shad0\\frz7.5\\t(0,70,\\frz13.5)\\t(70,140,\\frz1.5)\\t(140,210,\\frz10.5)\\t(210,280,\\frz7.5)}y",
        3: "Dialogue: 2,0:00:00.00,0:00:00.00,Text,,0,0,0,,{\\an5\\pos(0,0)\\fnGriun PolFairness\\fs100\\1c&HFFFFFF&\\3c&H00000000\\bord7\\shad0\\t(0,70,\\frz6)\\t(70,140,\\frz-6)\\t(140,210,\\frz3)\\t(210,280,\\frz-0)}z",
    }


def test_styles_in_layers(spark):
    rows = [("docu", None), ("docu", "drama_cine"), ("docu", "auto"), ("odd", "odd"), (None, None), ("romcom", "y2k_pink")]
    frame = spark.createDataFrame(rows, "genre string, wanted string")
    got = [r.p for r in frame.select(ass.chosen_preset(F.col("genre"), F.col("wanted")).alias("p")).collect()]
    assert got == ["hormozi", "drama_cine", "hormozi", "kvar_yellow", "kvar_yellow", "y2k_pink"]
    over = "struct<" + ass.STYLE.removeprefix("struct<")
    none = F.from_json(F.lit('{"font_size": 99, "bold": false}'), over)
    top = F.from_json(F.lit('{"font_size": 100}'), over)
    s = frame.limit(1).select(ass.overlaid(ass.chosen_style(F.col("genre"), F.col("wanted"), none), top, F.lit(None).cast(over)).alias("s")).first().s
    assert (s.font_name, s.font_size, s.bold, s.margin_v) == ("JalnanGothic", 100, False, 320)


def written(spark):
    names = spark.createDataFrame([("one/a.ass",), ("b.ass",)], "name string")
    main = ass.style(ass.PRESETS["kakao_bubble"])
    segments = spark.createDataFrame([(n, i, i * 1000, i * 1000 + 900, f"line {i} {n}") for n in ("one/a.ass", "b.ass") for i in range(300)], "name string, seg_idx int, start_ms long, end_ms long, text string")
    lines = ass.segment_lines(segments.withColumn("style", F.lit(None).cast("struct<size:double,y:double,color:string,rotate:double>")), main["alignment"])
    cues = ass.cue_lines(segments.limit(0).unionByName(segments.where("seg_idx = 3")).withColumnRenamed("seg_idx", "cue_idx"))
    return ass.header(names, main, ass.style(ass.PLAIN)).unionByName(lines).unionByName(cues)


def test_files_of_lines(spark, tmp_path):
    lines, folder = written(spark), tmp_path / "out"
    ass.save(lines.repartition(5), folder.as_uri())
    want = {}
    for r in sorted(lines.collect(), key=lambda r: r.place):
        want.setdefault(r.name, []).append(r.line)
    found = {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    assert found == {n: b"\xef\xbb\xbf" + "".join(f"{x}\n" for x in own).encode() for n, own in want.items()}
    assert want["b.ass"][0] == "[Script Info]" and want["b.ass"][-1].startswith("Dialogue: 0,0:00:03.00,0:00:03.90,TtsLine")
    assert "Style: Default,Mulmaru,56,&H00000000,&H00FFFFFF,&H00FFFFFF,0,0,3,0,0,2,80,80,380,0" in want["b.ass"]
    back = ass.load(spark, folder.as_uri(), ".ass")
    assert {(r.name, r.place, r.line) for r in back.collect()} == {(n, i, x) for n, own in want.items() for i, x in enumerate(own)}
    read = subtitles.read(spark, str(folder / "one"))
    assert read.count() == 301 and read.where("seg_idx = 5").first().start_ms == 5000
    whole = {r.path: r.value for r in ass.as_files(lines).collect()}
    assert {n: v.encode() for n, v in whole.items()} == found
    # Another append replaces a file of the same name only; overwriting leaves nothing else.
    ass.save(lines.where("name = 'b.ass' and place = 0"), str(folder))
    assert (folder / "b.ass").read_text("utf-8-sig").count("\n") == 1 and (folder / "one/a.ass").exists()
    ass.save(lines.where("name = 'b.ass' and place < 2").withColumn("name", F.lit("c.ass")), str(folder), "overwrite")
    assert [p.name for p in folder.rglob("*")] == ["c.ass"]
    ass.save(lines.limit(0), str(folder))
    assert [p.name for p in folder.rglob("*")] == ["c.ass"]


def test_names_that_leave_the_folder_and_failed_jobs(spark, tmp_path):
    lines = written(spark)
    for name in ("../x", "/x", "", "_x"):
        with pytest.raises(Exception, match="no name of a file"):
            ass.save(lines.withColumn("name", F.lit(name)), str(tmp_path / "out"))
    assert not [p for p in Path(tmp_path / "out").rglob("*") if p.is_file()]


def test_colours_rates_and_filters(spark):
    colours = [("White", "&H00FFFFFF"), ("#0a0B0c", "&H000C0B0A"), ("0a0b0c", "&H000C0B0A"), ("&H12", "&H12"), ("skyblue ", "&H00EBCE87"), ("mauve", None), (None, None), ("#12345", None)]
    rates = [("30000/1001", 30000 / 1001), ("25/1", 25.0), ("25", 30.0), ("1/0", 30.0), ("a/b", 30.0), (None, 30.0)]
    frame = spark.createDataFrame([(c, r) for (c, _), (r, _) in zip(colours, rates + rates[:2])], "c string, r string")
    got = frame.select(tx.any_colour(F.col("c")).alias("c"), tx.frame_rate(F.col("r")).alias("r")).collect()
    assert [r.c for r in got] == [x for _, x in colours] and [r.r for r in got][:6] == [x for _, x in rates]
    assert spark.createDataFrame([("a\\b:'[c]",)], "t string").select(tx.escape_drawtext(F.col("t")).alias("t")).first().t == "a\\\\b\\:’\\[c\\]"
