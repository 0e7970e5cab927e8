"""Worked cases: small inputs with the rows that must come out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanwise.functions import text as tx
from spanwise.functions import transcripts
from spanwise.operators import clips, folds, intervals, quotes
from spanwise.sources import stages, subtitles

SEGS = "source_id long, seg_idx long, start_ms long, end_ms long, text string"
CLIP = "source_id long, clip_idx long, start_ms long, end_ms long, visual_essential boolean, known boolean, essential boolean, description string"


def cut(spark, clip, segs, profile, known=True, essential=False, description="평범한 장면", visual=False):
    c = spark.createDataFrame([(1, 0, *clip, visual, known, essential, description)], CLIP)
    s = spark.createDataFrame([(1, i, a, z, t) for i, (a, z, t) in enumerate(segs)], SEGS)
    got = clips.cut_clips(c, s, ["source_id"], "clip_idx", profile).collect()
    return [(r.start_ms, r.end_ms) for r in sorted(got, key=lambda r: r.piece)]


def test_silence_presets():
    p = clips.CONSERVATIVE
    assert (p.gap_level, p.widest, p.pad, p.least, p.cap) == (False, 400, 150, 300, None)
    assert clips.silence_profile(" Aggressive ") is clips.AGGRESSIVE and clips.silence_profile(None) is p and clips.silence_profile("other") is p
    assert (clips.AGGRESSIVE.widest, clips.AGGRESSIVE.pad, clips.AGGRESSIVE.cap) == (300, 120, 1000)


THREE = [(500, 1000, "대사 A"), (12_000, 12_500, "대사 B"), (24_000, 24_500, "[내레이션] 끝")]


def test_one_protected_gap_does_not_keep_the_others(spark):
    assert cut(spark, (0, 30_000), THREE, clips.CONSERVATIVE) == [(0, 30_000)]
    assert cut(spark, (0, 30_000), THREE, clips.AGGRESSIVE) == [(380, 1120), (11_880, 13_000), (23_500, 24_620)]


def test_a_protected_gap_without_a_cap_stays(spark):
    from dataclasses import replace

    assert cut(spark, (0, 30_000), THREE, replace(clips.AGGRESSIVE, cap=None)) == [(380, 1120), (11_880, 24_620)]


def test_gaps_of_unknown_and_moving_clips(spark):
    segs = [(500, 1000, "a"), (9000, 11_500, "b")]
    for how in ({"known": False}, {"description": "두 사람이 키스한다"}):
        assert cut(spark, (0, 12_000), segs, clips.AGGRESSIVE, **how) == [(380, 1120), (8880, 11_620)]
        assert cut(spark, (0, 12_000), segs, clips.CONSERVATIVE, **how) == [(0, 12_000)]
    assert cut(spark, (0, 12_000), segs, clips.CONSERVATIVE) == [(350, 1150), (8850, 11_650)]


def test_small_gaps_are_bridged_and_whole_clips_stay(spark):
    segs = [(500, 1000, "A"), (1250, 1750, "B"), (5000, 5500, "C")]
    assert cut(spark, (0, 10_000), segs, clips.AGGRESSIVE) == [(380, 1870), (4880, 5620)]
    assert cut(spark, (0, 10_000), segs, clips.AGGRESSIVE, visual=True) == [(0, 10_000)]
    assert cut(spark, (0, 8000), [], clips.AGGRESSIVE) == [(0, 8000)] == cut(spark, (0, 8000), [], clips.CONSERVATIVE)


def test_text_heard_twice_gives_no_overlapping_pieces(spark):
    segs = [(918_500, 926_500, "앞부분 대사"), (926_960, 930_040, "아니 그게 무슨"), (927_390, 927_910, "해봐."), (928_270, 930_030, "아니 그게 진짜"), (930_500, 933_400, "뒷부분 대사")]
    got = cut(spark, (918_000, 933_550), segs, clips.AGGRESSIVE)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert sum(a <= 927_000 and z >= 930_000 for a, z in got) == 1


def fold_gaps(clip, segs, known, description, p):
    """Gap-level cut by a plain scan."""
    safe = lambda a, b: p.keep_unknown is False if not known else ("[내레이션]" in a) == ("[내레이션]" in b)
    pads = [(max(clip[0], a - p.pad), min(clip[1], z + p.pad)) for a, z, _ in segs]
    out, cur, far = [], pads[0], segs[0][1]
    for i in range(1, len(segs)):
        gap = segs[i][0] - far
        if gap >= p.widest and safe(segs[i - 1][2], segs[i][2]):
            out.append(cur)
            cur = (max(pads[i][0], cur[1]), pads[i][1])
        elif p.cap is not None and gap > p.cap:
            out.append((cur[0], max(cur[1], min(clip[1], far + p.cap // 2))))
            cur = (max(min(pads[i][0], max(clip[0], segs[i][0] - p.cap // 2)), out[-1][1]), pads[i][1])
        else:
            cur = (cur[0], max(cur[1], pads[i][1]))
        far = max(far, segs[i][1])
    out = [x for x in [*out, cur] if x[1] > x[0]]
    kept = []
    for a, z in out:
        if kept and z - a < p.least:
            kept[-1] = (kept[-1][0], z)
        else:
            kept.append((a, z))
    return kept


def test_gap_level_equals_a_scan(spark):
    import random
    from dataclasses import replace

    rnd = random.Random(5)
    for profile in (clips.AGGRESSIVE, replace(clips.AGGRESSIVE, widest=100, pad=400, cap=200), replace(clips.AGGRESSIVE, cap=None, pad=300)):
        rows, segs, want = [], [], {}
        for k in range(60):
            own = sorted((s := rnd.randrange(0, 9000), s + rnd.randrange(1, 1500), rnd.choice(["[내레이션] a", "b"])) for _ in range(rnd.randint(1, 9)))
            clip = (rnd.randrange(0, 3000), rnd.randrange(6000, 12_000))
            inside = [x for x in own if x[0] < clip[1] and x[1] > clip[0]]
            rows.append((k, 0, *clip, False, k % 3 > 0, False, ""))
            segs += [(k, i, a, z, t) for i, (a, z, t) in enumerate(own)]
            want[k] = fold_gaps(clip, inside, k % 3 > 0, "", profile) if inside else [clip]
        got = {}
        for r in sorted(clips.cut_clips(spark.createDataFrame(rows, CLIP), spark.createDataFrame(segs, SEGS), ["source_id"], "clip_idx", profile).collect(), key=lambda r: r.piece):
            got.setdefault(r.source_id, []).append((r.start_ms, r.end_ms))
        assert got == want


LINE = "저는 그날 밤에 아무 데도 가지 않았어요"
TALK = [(500_000, 505_000, "다른 이야기를 하고 있었죠"), (518_900, 524_200, LINE), (530_000, 531_000, "네?")]


@pytest.mark.parametrize("at, transcript, problem", [
    ((830_000, 887_000), f"[518.9~524.2] {LINE}!", (518_900, 524_200)), ((515_000, 530_000), LINE, None), ((524_000, 560_000), LINE, None),
    ((100_000, 130_000), "전사에 없는 대사입니다 정말로", None), ((830_000, 887_000), "네?", None), (None, LINE, None),
])
def test_misplaced_quotes(spark, at, transcript, problem):
    c = spark.createDataFrame([(1, 4, *(at or (None, None)), transcript, None)], "source_id long, cand long, start_ms long, end_ms long, transcript string, lines array<string>")
    s = spark.createDataFrame([(1, i, *x) for i, x in enumerate(TALK)], SEGS)
    r = quotes.misplaced(c, s, ["source_id"], "cand").first()
    assert (r.problem, (r.found_s, r.found_e)) == (problem is not None, problem or (None, None))


def test_quotes_run_over_segments_and_blocks(spark, monkeypatch):
    """All places of a quote, overlapping ones too, across segments and blocks."""
    monkeypatch.setattr(quotes, "BLOCK", 16)
    said = ["abcabcabcabc", "", "abc", "xyz!", "abcabcabcab", "c"]
    s = spark.createDataFrame([(1, i, 1000 * i, 1000 * i + 900, t) for i, t in enumerate(said)] + [(2, 0, 0, 1, "abcabcabcabcabc")], SEGS)
    q = spark.createDataFrame([(1, "abcabcabcabc"), (1, "cabcxyzabcabc"), (1, "bcabcabcabcabc"), (1, "nothere....."), (2, "abcabcabcabcabc")], "source_id long, needle string")
    got = {(r.source_id, r.needle, r.at, r.s_ms, r.e_ms) for r in quotes.quote_times(s, q, ["source_id"]).collect()}
    whole = {1: "".join(tx_normal(x) for x in said), 2: "abcabcabcabcabc"}
    owner = {1: [i for i, x in enumerate(said) for _ in tx_normal(x)], 2: [0] * 15}
    want = set()
    for k, n in [(1, "abcabcabcabc"), (1, "cabcxyzabcabc"), (1, "bcabcabcabcabc"), (2, "abcabcabcabcabc")]:
        for i in range(len(whole[k])):
            if whole[k].startswith(n, i):
                want.add((k, n, i, 1000 * owner[k][i], 1000 * owner[k][i + len(n) - 1] + (900 if k == 1 else 1)))
    assert got == want and len(want) >= 6


def tx_normal(text):
    return "".join(c for c in text if c.isascii() and c.isalnum())


def test_cover_dedup_of_a_short_source(spark):
    rows = [(1, 0, 32_000, 50_000), (1, 1, 32_000, 50_000), (1, 2, 38_000, 60_000), (2, 0, 10_000, 25_000), (2, 1, 40_000, 60_000)]
    got = folds.cover_dedup(spark.createDataFrame(rows, "source_id long, clip long, start_ms long, end_ms long"), ["source_id"], "clip").collect()
    assert {tuple(r) for r in got} == {(1, 0, 32_000, 50_000, 0), (1, 2, 50_000, 60_000, 1), (2, 0, 10_000, 25_000, 0), (2, 1, 40_000, 60_000, 1)}


def test_greedy_dedup_cases(spark):
    rows = [(1, 0, 550, 610, 800), (1, 1, 545, 605, 700), (2, 0, 100, 130, 5), (2, 1, 200, 230, 5)]
    got = folds.greedy_dedup(spark.createDataFrame(rows, "source_id long, cand long, start_ms long, end_ms long, score long"), ["source_id"], "cand", 0.7).collect()
    assert {(r.source_id, r.cand) for r in got} == {(1, 0), (2, 0), (2, 1)}


def test_wrap_is_greedy(spark):
    for text, width in (("one two  three\nfour", 8), ("x" * 20 + " a b", 8), ("", 5), ("가나 다라 🙂🙂 마", 5)):
        want, line = [], ""
        for w in text.split():
            if line and len(line) + 1 + len(w) <= width:
                line += " " + w
            else:
                want += [line] if line else []
                line = w
        want += [line] if line else []
        assert spark.createDataFrame([(text,)], "t string").select(tx.wrap(F.col("t"), width)).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("에스케이텔레콤 에서 일했다", "SK텔레콤 에서 일했다"), ("씨티오 출신", "CTO 출신"), ("엔씨소프트 대표", "NC소프트 대표"), ("아이티 업계 흐름", "IT업계 흐름"),
    ("삼십년 만이다", "30년 만이다"), ("삼십년을 버텼다", "30년을 버텼다"), ("이십사시간 영업", "24시간 영업"), ("십년대", "10년대"),
    ("아이티 는 카리브해 국가다", None), ("아이티오 회사", None), ("만원짜리 물건", None), ("삼십 이라고 했다", None), ("에스케이텔레콤이", None), ("", None), (" a  b ", None),
])
def test_notation(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(transcripts.restore_notation(F.col("t")).alias("r")).first().r
    assert r.text == (text if want is None else want) and bool(r.used) == (want is not None)


def test_notation_is_counted(spark):
    df = spark.createDataFrame([("씨티오 와 씨티오",), (None,)], "t string").select(transcripts.restore_notation(F.col("t"))["used"].alias("used"))
    assert {tuple(r) for r in transcripts.rules_used(df).collect()} == {("씨티오→CTO", 2)}


def test_kept_intervals_of_dropped_beats(spark):
    clip = spark.createDataFrame([(1, 0, 0, 30_000), (1, 1, 50_000, 60_000), (2, 0, 0, 5000)], "source_id long, clip long, start_ms long, end_ms long")
    none = spark.createDataFrame([], "source_id long, start_ms long, end_ms long")
    drop = lambda *rows: spark.createDataFrame(list(rows), "source_id long, r_start long, r_end long")
    cut = lambda drops, segs=none: {tuple(r) for r in intervals.kept_intervals(clip, drops, segs, ["source_id"], "clip").collect()}
    rest = {(1, 1, 50_000, 60_000), (2, 0, 0, 5000)}
    assert cut(drop((1, 10_000, 20_000))) == {(1, 0, 0, 10_000), (1, 0, 20_000, 30_000)} | rest
    assert cut(spark.createDataFrame([], "source_id long, r_start long, r_end long")) == {(1, 0, 0, 30_000)} | rest
    # Inner edges go to sentences; short pieces go, the longest stays when all are short; nothing left: the whole clip.
    said = spark.createDataFrame([(1, 1000, 8000), (1, 22_000, 29_000)], "source_id long, start_ms long, end_ms long")
    assert cut(drop((1, 10_000, 20_000)), said) == {(1, 0, 0, 8000), (1, 0, 22_000, 30_000)} | rest
    assert cut(drop((2, 1000, 3500))) == {(1, 0, 0, 30_000), (1, 1, 50_000, 60_000), (2, 0, 3500, 5000)}
    assert cut(drop((2, 0, 9000))) == {(1, 0, 0, 30_000)} | rest


def test_salvaged_json(spark):
    rows = [('```json\n{"a": 1}\n```', '{"a": 1}', 0), ('Here: {"a": "}"} and more', '{"a": "}"}', 9), ('{"a":1}{"b":2}', '{"a":1}', 7), ("[1, [2]] tail", "[1, [2]]", 5), ('{"a": [1', None, None), ("none", None, None), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(subtitles.salvage_json(F.col("t")).alias("s"))
    assert [(r.s.value, r.s.lost) if r.s else (None, None) for r in df.collect()] == [r[1:] for r in rows]


def test_subtitle_readers(spark):
    files = [
        ("a.srt", "1\n00:00:01,500 --> 00:00:02,000\n(Anna) <i>hi</i>\nthere [door]\n\n2\nbad\n\n3\n00:00:03,000 --> 00:00:04,000\n[only]\n"),
        ("b.vtt", "WEBVTT\n\n01:02.500 --> 01:03.000 align:start\n<v Bob>hello\n\n00:01:04.000 --> 00:01:05.000\nplain"),
        ("c.ass", "[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,D,,0,0,0,,one, two\\Nthree\n\n[Fonts]\nDialogue: 0,0:00:09.00,0:00:10.00,D,,0,0,0,,no\n"),
        ("d.smi", '<SYNC Start=1000><P Class="KRCC">first<SYNC Start=2500><P Class=kim>second<br>line<SYNC Start=4000><P Class=KRCC>&nbsp;'),
    ]
    got = {(r.path, r.seg_idx, r.start_ms, r.end_ms, r.text) for r in subtitles.parse(spark.createDataFrame(files, "path string, value string")).collect()}
    assert got == {
        ("a.srt", 0, 1500, 2000, "Anna: hi there"), ("b.vtt", 0, 62_500, 63_000, "Bob: hello"), ("b.vtt", 1, 64_000, 65_000, "plain"), ("c.ass", 0, 1500, 2000, "one, two three"),
        ("d.smi", 0, 1000, 2500, "first"), ("d.smi", 1, 2500, 4000, "kim: second line"),
    }
    with pytest.raises(Exception, match="no reader"):
        subtitles.parse(spark.createDataFrame([("a.txt", "x")], "path string, value string")).collect()


def test_stages_are_resumed(spark, tmp_path):
    ran = []
    stage = lambda name, n: (name, lambda df: ran.append(name) or df.withColumn("x", F.col("x") + n))
    three = [stage("one", 1), stage("two", 10), stage("three", 100)]
    first = spark.range(3).select(F.col("id").alias("x"))
    assert sorted(r.x for r in stages.run(spark, first, three, str(tmp_path)).collect()) == [111, 112, 113] and ran == ["one", "two", "three"]
    assert sorted(r.x for r in stages.run(spark, first, three, str(tmp_path), "three").collect()) == [111, 112, 113] and ran[3:] == ["three"]


def test_streams(spark, tmp_path):
    from spanwise.streaming import events

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.read(spark, f"{tmp_path}/in", rows.schema)
    for name, out in (("sessions", events.session_counts(stream)), ("windows", events.window_values(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    whole = batch.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n")
    got = {tuple(r) for r in spark.table("windows").select("event_type", "start", "n").collect()}
    # Windows that the watermark has not passed stay open.
    late = {tuple(r) for r in whole.collect()} - got
    assert got and got <= {tuple(r) for r in whole.collect()} and len(late) < 10
    assert spark.table("sessions").agg(F.sum("n")).first()[0] > 900
