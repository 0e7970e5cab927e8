"""Answers against a plain reading of them, extensions, restored columns and places in a character index."""

import json
import random

from pyspark.sql import functions as F

from spanwise.operators import answers, clips, intervals

HIGH = {"shorts_type": "highlight", "score": 0.9, "start_sec": 1, "end_sec": 2}
TALE = {"shorts_type": "storytelling", "score": 0.5, "storyline": {"hook": {"start_sec": 1, "end_sec": 2}, "payoff": {"start_sec": 3, "end_sec": 4}}}


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "id long, document string")


def test_story_answers(spark):
    cases = [
        ({"storylines": [HIGH, TALE], "title_txt": "t"}, "ok"), ({"stories": [HIGH], "title_line1": "t"}, "ok"), ({"storylines": None, "options": [], "output": [TALE], "title_txt": ""}, "ok"), ({"selected_storyline": HIGH, "title_txt": "t"}, "ok"),
        (HIGH | {"title_txt": "t"}, "ok"), ({"shorts_type": "x", "title_txt": "t"}, "no storylines"), ({"storylines": [], "title_txt": "t"}, "empty storylines"), ({"storylines": [HIGH]}, "no title"), ([1], "no object"),
        ({"storylines": [HIGH, {}], "title_txt": "t"}, "storyline 1: no shorts_type"), ({"storylines": [{"shorts_type": "block"}], "title_txt": "t"}, "storyline 0: no score"), ({"storylines": [{"shorts_type": "highlight", "score": 1, "start_sec": None}], "title_txt": "t"}, "storyline 0: no end_sec"),
        ({"storylines": [{"shorts_type": "storytelling", "score": 1}], "title_txt": "t"}, "storyline 0: no storyline"), ({"storylines": [TALE | {"storyline": {"hook": {"start_sec": 1}}}], "title_txt": "t"}, "storyline 0: no hook end_sec"),
        ({"storylines": [TALE | {"storyline": {"hook": {"start_sec": 1, "end_sec": 2}}}], "title_txt": "t"}, "storyline 0: no payoff"), ({"storylines": [TALE | {"storyline": {}}], "title_txt": "t"}, "storyline 0: no storyline"),
    ]
    docs = frame(spark, [json.dumps(d) for d, _ in cases])
    assert [r.reason for r in answers.story_reasons(docs, "id").orderBy("id").collect()] == [r for _, r in cases]
    assert {r.id for r in answers.stories(docs, "id").collect()} == {i for i, (_, r) in enumerate(cases) if r == "ok"}
    title = "가나다라마바사아자차카타파하" * 2
    docs = frame(spark, [json.dumps(x) for x in ({"storylines": [HIGH, TALE | {"title_line1": "own", "sequence_type": "odd", "ending_hook": "h"}], "title_txt": title}, {"storylines": [TALE | {"sequence_type": "반전형"}], "title_line1": "one"})])
    got = [tuple(r)[:-1] for r in answers.stories(docs, "id").orderBy("id", "story_idx").collect()]
    assert got == [(0, 0, "highlight", 0.9, None, title[:20], title[20:40], ""), (0, 1, "storytelling", 0.5, "여정몰입형", "own", title[20:40], "h"), (1, 0, "storytelling", 0.5, "반전형", "one", "", "")]


def test_moment_answers(spark):
    base = {"chunk_index": 0, "chunk_start_sec": 0, "chunk_end_sec": 9, "summary": ""}
    rnd = random.Random(2)
    docs = [base, base | {"candidate_moments": {}}, base | {"candidate_moments": []}, base | {"candidate_moments": [3, {"start_sec": 1}]}, {k: v for k, v in base.items() if k != "summary"} | {"candidate_moments": []}]
    for _ in range(40):
        rows = []
        for _ in range(rnd.randint(1, 7)):
            m = {"start_sec": rnd.random() * 9, "end_sec": "9.5", "description": "d", "candidate_index": rnd.choice([None, 1, 2, 7, "3", 2.0]), "reason": "r"}
            for k in ("end_sec", "candidate_index", "reason"):
                if rnd.random() < 0.2:
                    del m[k]
            rows.append(m if rnd.random() < 0.9 else 5)
        docs.append(base | {"candidate_moments": rows})

    def plain(d):
        missing = sorted({*answers.ANSWER_KEYS} - d.keys())
        if missing:
            return f"no {missing[0]}", []
        if not isinstance(d["candidate_moments"], list):
            return "no list", []
        used = {m["candidate_index"] for m in d["candidate_moments"] if isinstance(m, dict) and isinstance(m.get("candidate_index"), int)}
        after, out = max(used, default=-1) + 1, []
        for i, m in enumerate(d["candidate_moments"]):
            if isinstance(m, dict) and all(k in m for k in answers.MOMENT_KEYS):
                index = m.get("candidate_index")
                if not isinstance(index, int):
                    index, after = after, after + 1
                out.append((i, index, int(float(m["start_sec"]) * 1000 + 0.5), 9500, "d", m.get("reason", ""), ""))
        return ("ok" if out else "no usable moments"), out

    frame_ = frame(spark, [json.dumps(d) for d in docs])
    assert [r.reason for r in answers.moment_reasons(frame_, "id").orderBy("id").collect()] == [plain(d)[0] for d in docs]
    got = {}
    for r in answers.moments(frame_, "id").orderBy("moment_idx").collect():
        got.setdefault(r.id, []).append(tuple(r[c] for c in ("moment_idx", "candidate_index", "start_ms", "end_ms", "description", "reason", "transcript")))
    assert got == {i: plain(d)[1] for i, d in enumerate(docs) if plain(d)[1]}


def test_guides(spark):
    cases = [
        (None, "ok", None), (" ", "ok", None), ("{}", "ok", None), ("[]", "no object", None), ("{", "no object", None), ('{"_note": 1, "tone": " dry "}', "ok", (None, None, None, "dry")), ('{"b": 1, "a": 2}', "unknown key a", None),
        ('{"avoid": [" x ", ""], "rules": [], "prefer": null}', "ok", (["x"], None, None, None)), ('{"avoid": "x"}', "avoid is no list of texts", None), ('{"rules": ["a", 1]}', "rules is no list of texts", None), ('{"tone": 3}', "tone is no text", None), ('{"prefer": [" "]}', "ok", None),
    ]
    got = frame(spark, [d for d, _, _ in cases]).select("id", answers.guide_reason(F.col("document")).alias("r"), answers.guide(F.col("document")).alias("g")).orderBy("id").collect()
    assert [(r.r, r.g and tuple(r.g)) for r in got] == [(reason, made) for _, reason, made in cases]


def test_widened_and_restored(spark):
    shape = "source_id long, cand_idx long, start_ms long, end_ms long, context_extension struct<needed:boolean,start_ms:long,end_ms:long>"
    rows = [(1, 0, 10, 20, (True, 5, 15)), (1, 1, 30, 40, (False, 0, 99)), (1, 2, 50, 60, None), (1, 3, 70, 80, (True, None, 90))]
    wide = intervals.widened(spark.createDataFrame(rows, shape))
    assert [(r.start_ms, r.end_ms) for r in wide.orderBy("cand_idx").collect()] == [(5, 20), (30, 40), (50, 60), (70, 90)]
    known = spark.createDataFrame([(0, 1, 5, 6, "d", True, "draft")], "chunk_index long, candidate_index long, start_ms long, end_ms long, description string, visual_essential boolean, tts_draft string")
    asks = spark.createDataFrame([(0, 0, 1, 1, 2, "x", False, "mine"), (1, 0, 2, 1, 2, "x", False, "mine"), (2, 9, 9, 1, 2, "x", None, None)], "clip_idx long, chunk_index long, candidate_index long, start_ms long, end_ms long, description string, visual_essential boolean, tts_draft string")
    aliases = spark.createDataFrame([(9, 9, 0, 1)], "chunk_index long, candidate_index long, to_chunk long, to_candidate long")
    got = clips.restore_times(asks, known, aliases, ["visual_essential", "tts_draft"]).orderBy("clip_idx").collect()
    assert [(r.start_ms, r.description, r.visual_essential, r.tts_draft) for r in got] == [(5, "d", True, "draft"), (1, "x", False, "mine"), (5, "d", True, "draft")]


def test_places_in_an_index(spark):
    rnd = random.Random(9)
    shown = [(s, i, rnd.choice("ab"), a, a + rnd.randint(0, 8000), [(a + rnd.randint(-4000, 9000), rnd.random(), rnd.random()) for _ in range(rnd.randint(0, 5))]) for s in range(5) for i, a in enumerate(rnd.sample(range(0, 60_000, 500), 9))]
    asks = [(s, k, rnd.choice("abc"), rnd.randrange(0, 70_000, 250)) for s in range(6) for k in range(60)]
    got = clips.find_in_index(spark.createDataFrame(asks, "source_id long, ask long, character string, at_ms long"), spark.createDataFrame(shown, "source_id long, appearance_idx long, character string, start_ms long, end_ms long, samples array<struct<t_ms:long,x:double,y:double>>"), ["source_id"], "ask", 1920, 1080)
    want = {}
    for s, k, who, t in asks:
        best = None
        for own, _, name, a, z, samples in shown:
            if own == s and name == who and a - 1000 <= t <= z + 1000:
                for at, x, y in samples:
                    if abs(at - t) <= 3000 and (best is None or abs(at - t) < best[0]):
                        best = (abs(at - t), x * 1920, y * 1080)
        want[s, k] = best and best[1:]
    assert {(r.source_id, r.ask): None if r.x is None else (r.x, r.y) for r in got.collect()} == want
    assert sum(v is not None for v in want.values()) > 30
