"""Injected functions and their fallbacks, storyline branches, override contracts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanwise.functions import text as tx
from spanwise.operators import clips, documents, folds, hooks


def hear(path):
    if path == "bad":
        raise OSError(path)
    return [{"start_ms": 0, "end_ms": 500, "text": path}, {"start_ms": 700, "end_ms": 900, "text": "more"}]


def test_transcribe(spark):
    chunks = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 4200), (1, 2, "bad", 8400)], "source_id long, chunk_index int, path string, r_start long")
    got = {tuple(r) for r in hooks.transcribe(chunks, hear).collect()}
    assert got == {(1, 0, 0, 0, 500, "a"), (1, 0, 1, 700, 900, "more"), (1, 1, 0, 4200, 4700, "b"), (1, 1, 1, 4900, 5100, "more")}


def half(text, target):
    if text.startswith("x"):
        raise ValueError
    return text[: target // 2]


def test_shorten(spark):
    df = spark.createDataFrame([("a long, long text", 8), ("short", 8), ("xa, long text", 4), (None, 3)], "t string, n int")
    assert [r.s for r in df.select(hooks.shorten(F.col("t"), F.col("n"), half).alias("s")).collect()] == ["a lo", "short", "xa.", None]
    assert [r.s for r in df.select(hooks.shorten(F.col("t"), F.col("n")).alias("s")).collect()] == ["a long.", "short", "xa.", None]


def test_relations_and_drops(spark):
    c = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "source_id long, cand long, description string")
    chain = lambda rows: [{"a": r["cand"], "b": r["cand"] + 1, "type": "continuous"} for r in rows[:-1]] if len(rows) > 1 else 1 / 0
    assert [tuple(r) for r in hooks.relate(c, ["source_id"], chain, ["cand", "description"]).collect()] == [(1, 0, 1, "continuous")]
    b = spark.createDataFrame([(1, 0, 0, "core"), (1, 0, 1, "supporting"), (1, 0, 2, "droppable"), (1, 0, 3, "droppable")], "source_id long, clip long, beat long, importance string")
    order = lambda f: [r.beat for r in sorted(hooks.chosen_drops(b, ["source_id"], "clip", "beat", f).collect(), key=lambda r: r.place)]
    assert order(None) == order(lambda rows: 1 / 0) == order(lambda rows: [{"clip": 9, "beat": 9}, "no"]) == [2, 3, 1]
    assert order(lambda rows: [{"clip": 0, "beat": 1}, {"clip": 5}, {"clip": 0, "beat": 0}]) == [1, 0]


def test_fallback_story(spark):
    c = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 5)], "source_id long, cand long")
    assert {tuple(r) for r in hooks.fallback_story(c, ["source_id"], "cand").select("source_id", "cand", "role").collect()} == {(1, 0, "hook"), (1, 3, "build"), (1, 6, "build"), (1, 8, "payoff"), (2, 5, "hook")}


def test_storyline_branches(spark):
    p = lambda a, z, k=0: {"start_ms": a, "end_ms": z, "chunk_index": 0, "candidate_index": k}
    kind = clips.PIECE
    shape = f"variant_id long, hook {kind}, hook_preview {kind}, build array<{kind}>, payoff {kind}, highlight {kind}, block array<{kind}>"
    rows = [
        (0, p(0, 9), None, [p(10, 20)], p(5, 30), None, None),  # no preview: nothing is absorbed
        (1, p(1000, 9000), p(2000, 4000, 1), [p(10_000, 20_000)], p(8000, 30_000), None, None),
        (2, p(1000, 9000), p(2000, 4000, 1), [], p(20_000, 30_000), None, None),
        (3, p(1000, 9000), p(2000, 4000, 0), None, p(20_000, 30_000), None, None),
        (4, p(1000, 9000), p(2000, 2900, 1), None, None, None, None),  # a preview under a second
        (5, p(1, 2), None, None, None, p(7, 8), None), (6, p(1, 2), None, None, None, None, [p(50, 60), p(10, 20)]),
    ]
    got = {}
    for r in sorted(clips.storyline_clips(spark.createDataFrame(rows, shape)).collect(), key=lambda r: r.clip_idx):
        got.setdefault(r.variant_id, []).append((r.role, r.start_ms, r.end_ms))
    assert got == {
        0: [("hook", 0, 9), ("build", 10, 20), ("payoff", 5, 30)], 1: [("hook", 2000, 4000), ("build", 10_000, 20_000), ("payoff", 1000, 30_000)],
        2: [("hook", 2000, 4000), ("build", 1000, 9000), ("payoff", 20_000, 30_000)], 3: [("hook", 2000, 4000), ("payoff", 20_000, 30_000)], 4: [("hook", 1000, 9000)],
        5: [("payoff", 7, 8)], 6: [("hook", 1, 2), ("build", 10, 20), ("payoff", 50, 60)],
    }


V = '"schema":"edit_overrides/v%d"'


@pytest.mark.parametrize("document, reason", [
    ("[1]", "not an object"), ('{"schema":"edit_v1"}', "unknown schema"), ("{%s}" % (V % 1), "ok"), ('{%s,"title":{"top_title":" "}}' % (V % 1), "title: blank"),
    ('{%s,"title":{"segments":[]}}' % (V % 2), "title: segments need the newest schema"), ('{%s,"clips":[]}' % (V % 1), "clips: not a list with rows"), ('{%s,"clips":{}}' % (V % 1), "clips: not a list with rows"),
    ('{%s,"clips":[{"start_sec":3,"end_sec":2}]}' % (V % 1), "clips: times"), ('{%s,"clips":[{"start_sec":-1,"end_sec":2}]}' % (V % 1), "clips: times"), ('{%s,"clips":[{"start_sec":1}]}' % (V % 1), "clips: times"),
    ('{%s,"clips":[{"start_sec":1,"end_sec":2,"role":"x"}]}' % (V % 1), "clips: role"), ('{%s,"clips":[{"start_sec":1,"end_sec":2}]}' % (V % 1), "ok"),
    ('{%s,"subtitles":[{"start_sec":1,"end_sec":2,"text":" "}]}' % (V % 2), "subtitles: blank"), ('{%s,"subtitles":[{"start_sec":1,"end_sec":2,"text":"a","source_time_sec":1}]}' % (V % 2), "subtitles: anchors need the newest schema"),
    ('{%s,"subtitles":[{"start_sec":1,"end_sec":2,"text":"a","source_time_sec":1}]}' % (V % 3), "ok"), ('{%s,"tts":[]}' % (V % 2), "ok"), ('{%s,"tts":{}}' % (V % 2), "tts: not a list"),
    ('{%s,"tts":[{"source_time_sec":-1,"text":"a"}]}' % (V % 2), "tts: time"), ('{%s,"tts":[{"source_time_sec":1,"text":"a","duration_sec":0}]}' % (V % 2), "tts: duration"),
    ('{%s,"images":[{"source_time_sec":1,"duration_sec":1}]}' % (V % 2), "images: need the newest schema"), ('{%s,"images":[{"source_time_sec":1}]}' % (V % 3), "images: times"),
    ('{%s,"texts":[{"source_time_sec":1,"duration_sec":1,"text":""}]}' % (V % 3), "texts: blank"), (None, "not an object"),
])
def test_override_contract(spark, document, reason):
    assert spark.createDataFrame([(document,)], "d string").select(documents.override_reason(F.col("d")).alias("r")).first().r == reason


def test_repetitions(spark):
    cases = [("ha ha ha", False), ("hahaha", True), ("so so so so ", True), ("코리아 시즌 2등 코리아 시즌 2등 코리아 시즌 2등 ", True), ("aaa", False), ("aaaaaa", True), ("ab" * 2, False), ("x" + "abc\n" * 3, True), ("", False)]

    def brute(t):
        t = " ".join(t.split())
        return any(t[i : i + n].strip() and t[i : i + n] == t[i + n : i + 2 * n] == t[i + 2 * n : i + 3 * n] for n in range(2, 21) for i in range(len(t) - 3 * n + 1))

    got = [r.r for r in spark.createDataFrame([(t,) for t, _ in cases], "t string").select(tx.repeats(F.col("t")).alias("r")).collect()]
    assert got == [brute(t) for t, _ in cases]


def test_small_scans_by_hand(spark):
    rows = [(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 2, 1, "a"), (1, 3, 0, "b"), (1, 4, 1, "")]
    got = folds.diverse(spark.createDataFrame(rows, "source_id long, rank long, chunk long, kind string"), ["source_id"], "rank", "chunk", "kind", 4).collect()
    assert [r.rank for r in sorted(got, key=lambda r: r.place)] == [0, 2, 3, 1]
    got = folds.push_apart(spark.createDataFrame([(1, 0, 0, 1000, 5000), (1, 1, 500, 1500, 5000), (1, 2, 4000, 6000, 5000), (1, 3, 4900, 6000, 5000)], "source_id long, cue long, start_ms long, end_ms long, total long"), ["source_id"], "cue", "total").collect()
    assert {(r.cue, r.start_ms, r.end_ms) for r in got} == {(0, 0, 1000), (1, 1050, 2050), (2, 4000, 5000)}
    got = folds.smooth(spark.createDataFrame([(1, i, x) for i, x in enumerate([0.9, 0.52, None, 0.9, 0.9, 0.9])], "source_id long, t long, x double"), ["source_id"], "t", "x").collect()
    want, x, left = [], 0.5, 4
    for goal in (0.9, 0.52, None, 0.9, 0.9, 0.9):
        if goal is not None:
            if abs(goal - x) > 0.05:
                a = 0.03 if left > 0 else 0.12
                x = a * goal + (1 - a) * x
            left -= 1
        want.append(round(x, 9))
    assert [round(r.smooth, 9) for r in sorted(got, key=lambda r: r.t)] == want
    beats = [(1, 0, 0, 0, 40, "core", False), (1, 0, 1, 40, 50, "supporting", False), (1, 0, 2, 50, 60, "droppable", True), (1, 0, 3, 60, 70, "droppable", False), (1, 1, 0, 0, 30, "droppable", False)]
    got = folds.trim_beats(spark.createDataFrame(beats, "source_id long, clip long, beat long, start_ms long, end_ms long, importance string, protected boolean"), ["source_id"], "clip", "beat", 70, 82).collect()
    assert {(r.clip, r.beat) for r in got if r.dropped} == {(0, 3), (0, 1)}
