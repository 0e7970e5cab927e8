"""The override contract against a plain walk of random documents, and one failing document a rule."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanwise.operators import contract

V3 = contract.NEWEST
CLIP = {"start_sec": 1, "end_sec": 2.5}
LINE = {"start_sec": 0, "end_sec": 2, "text": "said"}
CUE = {"source_time_sec": 3, "text": "told"}
IMAGE = {"file": "a/b.png", "source_time_sec": 1, "duration_sec": 2, "x": 0, "y": 1, "w": 0.5}
TEXT = {"text": "boom", "source_time_sec": 1, "duration_sec": 2, "x": 0.1, "y": 0.2}
PART = {"text": "title", "start_sec": 0, "end_sec": 3}


def plain(doc):
    """The first thing that a parsed document breaks, told in the contract's words."""

    def num(x):
        if isinstance(x, bool):
            return float(x)
        if isinstance(x, (int, float)):
            return float(x)
        if isinstance(x, str) and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", x, re.A):
            return float(x)
        return None

    def text(x):
        return x if isinstance(x, str) else "null" if x is None else json.dumps(x)

    class Bad(Exception):
        pass

    def need(ok, where, reason):
        if not ok:
            raise Bad(f"{where}: {reason}")

    def numeric(o, k, where, low=None, high=None, above=None, needed=True):
        if o.get(k) is None and not needed:
            return
        x = num(o.get(k))
        need(x is not None, where, f"{k} is no number")
        if above is not None:
            need(x > above, where, f"{k} is not above {above:g}")
        elif low is not None:
            need(low <= x <= (float("inf") if high is None else high), where, f"{k} is out of range")

    def span(o, where):
        for k in ("start_sec", "end_sec"):
            numeric(o, k, where)
        need(num(o["start_sec"]) >= 0, where, "start_sec is out of range")
        need(num(o["start_sec"]) < num(o["end_sec"]), where, "times are turned")

    def turn(o, where):
        numeric(o, "rotate", where, -180, 180, needed=False)

    def known(o, keys, where, reason="has an unknown key"):
        need(not set(o) - set(keys), where, reason)

    def color(o, where):
        need(o.get("color") is None or re.match(r"^#[0-9A-Fa-f]{6}$", text(o["color"])), where, "color is no #RRGGBB")

    try:
        need(isinstance(doc, dict), "document", "is no object")
        stamp = doc.get("schema")
        need(isinstance(stamp, str) and stamp in contract.STAMPS, "document", "schema is unknown")
        title = doc.get("title") or {}
        need(isinstance(title, dict), "title", "is no object")
        need(title.get("top_title") is None or text(title["top_title"]).strip(), "title", "top_title is blank")
        parts = title.get("segments")
        if parts is not None:
            w = "title.segments"
            need(stamp == V3, w, "needs the newest schema")
            need(isinstance(parts, list) and parts, w, "is no list with rows")
            need(len(parts) <= 20, w, "has over 20 rows")
            for i, o in enumerate(parts):
                w = f"title.segments[{i}]"
                need(isinstance(o, dict), w, "is no object")
                known(o, ("text", "start_sec", "end_sec"), w)
                span(o, w)
                need(text(o.get("text", "")).strip(), w, "text is blank")
            order = sorted((num(o["start_sec"]), num(o["end_sec"]), i) for i, o in enumerate(parts))
            need(all(b[0] >= a[1] - 1e-9 for a, b in zip(order, order[1:])), "title.segments", "rows overlap")
        for name in ("clips", "subtitles", "tts", "images", "texts"):
            rows = doc.get(name)
            if rows is None:
                continue
            if name in ("images", "texts"):
                need(stamp == V3, name, "needs the newest schema")
            if name == "tts":
                need(isinstance(rows, list), name, "is no list")
            else:
                need(isinstance(rows, list) and rows, name, "is no list with rows")
            for i, o in enumerate(rows):
                w = f"{name}[{i}]"
                need(isinstance(o, dict), w, "is no object")
                if name == "clips":
                    span(o, w)
                    need(o.get("role", "build") in contract.ROLES if isinstance(o.get("role", "build"), (str, type(None))) else False, w, "role is unknown")
                elif name == "subtitles":
                    span(o, w)
                    need(text(o.get("text", "")).strip(), w, "text is blank")
                    if o.get("source_time_sec") is not None or o.get("style") is not None:
                        need(stamp == V3, w, "anchor and style need the newest schema")
                    numeric(o, "source_time_sec", w, 0, needed=False)
                    style = o.get("style")
                    if style is not None:
                        w = f"subtitles[{i}].style"
                        need(isinstance(style, dict) and style, w, "style is no object with keys")
                        known(style, ("size", "y", "color", "rotate"), w, "style has an unknown key")
                        numeric(style, "size", w, above=0, needed=False)
                        numeric(style, "y", w, 0, 1, needed=False)
                        color(style, w)
                        turn(style, w)
                elif name == "tts":
                    numeric(o, "source_time_sec", w, 0)
                    need(text(o.get("text", "")).strip(), w, "text is blank")
                    numeric(o, "duration_sec", w, above=0, needed=False)
                elif name == "images":
                    known(o, contract.IMAGE_KEYS, w)
                    file = text(o.get("file") or "").strip()
                    need(file, w, "file is blank")
                    need(not file.startswith(("/", "~")) and ".." not in file.split("/"), w, "file leaves the folder")
                    need(re.search(r"[^/]\.(png|jpg|jpeg)/*$", file, re.I), w, "file is no png or jpg")
                    numeric(o, "source_time_sec", w, 0)
                    numeric(o, "duration_sec", w, above=0)
                    for k in ("x", "y", "w"):
                        numeric(o, k, w, 0, 1)
                    need(o.get("layer") is None or isinstance(o["layer"], int), w, "layer is no integer")
                    turn(o, w)
                else:
                    known(o, contract.TEXT_KEYS, w)
                    said = text(o.get("text") or "")
                    need(said.strip(), w, "text is blank")
                    need(len(said) <= 60, w, "text is over 60 letters")
                    numeric(o, "source_time_sec", w, 0)
                    numeric(o, "duration_sec", w, above=0)
                    for k in ("x", "y"):
                        numeric(o, k, w, 0, 1)
                    numeric(o, "size", w, 12, 400, needed=False)
                    color(o, w)
                    for k, names in (("stroke", contract.STROKES), ("fx", contract.EFFECTS), ("font", contract.FONTS)):
                        need(o.get(k) is None or isinstance(o[k], str) and o[k] in names, w, f"{k} is unknown")
                    turn(o, w)
    except Bad as e:
        return str(e)
    return "ok"


def told(spark, docs):
    frame = spark.createDataFrame(list(enumerate(docs)), "id long, document string")
    return [r.reason for r in contract.first_violation(frame, "id").orderBy("id").collect()]


def whole(**more):
    return {"schema": V3} | more


#: One document a rule, with what it breaks.
CASES = [
    ([1], "document: is no object"), ({"schema": "edit_overrides/v9"}, "document: schema is unknown"), ({}, "document: schema is unknown"),
    (whole(title=[1]), "title: is no object"), (whole(title=[]), "ok"), (whole(title={"top_title": " 　"}), "title: top_title is blank"), (whole(title={"top_title": 5}), "ok"),
    ({"schema": contract.STAMPS[1], "title": {"segments": [PART]}}, "title.segments: needs the newest schema"), (whole(title={"segments": []}), "title.segments: is no list with rows"), (whole(title={"segments": {}}), "title.segments: is no list with rows"),
    (whole(title={"segments": [{**PART, "start_sec": i, "end_sec": i + 1} for i in range(21)]}), "title.segments: has over 20 rows"), (whole(title={"segments": [3]}), "title.segments[0]: is no object"),
    (whole(title={"segments": [PART | {"size": 3}]}), "title.segments[0]: has an unknown key"), (whole(title={"segments": [{"text": "a", "start_sec": 0}]}), "title.segments[0]: end_sec is no number"),
    (whole(title={"segments": [PART | {"start_sec": -1}]}), "title.segments[0]: start_sec is out of range"), (whole(title={"segments": [PART | {"end_sec": 0}]}), "title.segments[0]: times are turned"),
    (whole(title={"segments": [PART | {"text": "\n"}]}), "title.segments[0]: text is blank"), (whole(title={"segments": [PART | {"start_sec": 2.9, "end_sec": 4}, PART]}), "title.segments: rows overlap"),
    (whole(title={"segments": [PART, PART | {"start_sec": 3, "end_sec": 4}]}), "ok"),
    (whole(clips=[]), "clips: is no list with rows"), (whole(clips="no"), "clips: is no list with rows"), (whole(clips=[CLIP, None]), "clips[1]: is no object"), (whole(clips=[{"start_sec": "x", "end_sec": 1}]), "clips[0]: start_sec is no number"),
    (whole(clips=[{"start_sec": " 1.5 ", "end_sec": "2e0", "extra": 1}]), "ok"), (whole(clips=[CLIP | {"start_sec": -0.5}]), "clips[0]: start_sec is out of range"), (whole(clips=[CLIP | {"end_sec": True}]), "clips[0]: times are turned"),
    (whole(clips=[CLIP | {"role": "intro"}]), "clips[0]: role is unknown"), (whole(clips=[CLIP | {"role": None}]), "clips[0]: role is unknown"), (whole(clips=[CLIP | {"role": "payoff"}]), "ok"),
    (whole(subtitles=[]), "subtitles: is no list with rows"), (whole(subtitles=[LINE | {"text": ""}]), "subtitles[0]: text is blank"), (whole(subtitles=[LINE, LINE | {"end_sec": 0}]), "subtitles[1]: times are turned"),
    ({"schema": contract.STAMPS[0], "subtitles": [LINE | {"source_time_sec": 3}]}, "subtitles[0]: anchor and style need the newest schema"), ({"schema": contract.STAMPS[1], "subtitles": [LINE | {"style": {"size": 3}}]}, "subtitles[0]: anchor and style need the newest schema"),
    (whole(subtitles=[LINE | {"source_time_sec": "soon"}]), "subtitles[0]: source_time_sec is no number"), (whole(subtitles=[LINE | {"source_time_sec": -1}]), "subtitles[0]: source_time_sec is out of range"),
    (whole(subtitles=[LINE | {"style": {}}]), "subtitles[0].style: style is no object with keys"), (whole(subtitles=[LINE | {"style": {"bold": 1}}]), "subtitles[0].style: style has an unknown key"),
    (whole(subtitles=[LINE | {"style": {"size": 0}}]), "subtitles[0].style: size is not above 0"), (whole(subtitles=[LINE | {"style": {"y": 1.01}}]), "subtitles[0].style: y is out of range"),
    (whole(subtitles=[LINE | {"style": {"color": "#12345"}}]), "subtitles[0].style: color is no #RRGGBB"), (whole(subtitles=[LINE | {"style": {"rotate": 181}}]), "subtitles[0].style: rotate is out of range"),
    (whole(subtitles=[LINE | {"style": {"size": 64, "y": 0.8, "color": "#FFdd00", "rotate": -180}, "source_time_sec": 0}]), "ok"),
    (whole(tts={}), "tts: is no list"), (whole(tts=[]), "ok"), (whole(tts=["x"]), "tts[0]: is no object"), (whole(tts=[{"text": "a"}]), "tts[0]: source_time_sec is no number"), (whole(tts=[CUE | {"source_time_sec": -1}]), "tts[0]: source_time_sec is out of range"),
    (whole(tts=[CUE | {"text": " "}]), "tts[0]: text is blank"), (whole(tts=[CUE | {"duration_sec": "x"}]), "tts[0]: duration_sec is no number"), (whole(tts=[CUE | {"duration_sec": 0}]), "tts[0]: duration_sec is not above 0"),
    ({"schema": contract.STAMPS[1], "images": [IMAGE]}, "images: needs the newest schema"), (whole(images=[]), "images: is no list with rows"), (whole(images=[1]), "images[0]: is no object"), (whole(images=[IMAGE | {"h": 1}]), "images[0]: has an unknown key"),
    (whole(images=[IMAGE | {"file": " "}]), "images[0]: file is blank"), (whole(images=[IMAGE | {"file": "/a.png"}]), "images[0]: file leaves the folder"), (whole(images=[IMAGE | {"file": "a/../b.png"}]), "images[0]: file leaves the folder"),
    (whole(images=[IMAGE | {"file": "a.gif"}]), "images[0]: file is no png or jpg"), (whole(images=[IMAGE | {"file": "a/.png"}]), "images[0]: file is no png or jpg"), (whole(images=[IMAGE | {"file": "a..b.JPEG"}]), "ok"),
    (whole(images=[IMAGE | {"source_time_sec": None}]), "images[0]: source_time_sec is no number"), (whole(images=[IMAGE | {"duration_sec": -1}]), "images[0]: duration_sec is not above 0"), (whole(images=[IMAGE | {"w": 1.5}]), "images[0]: w is out of range"),
    (whole(images=[IMAGE | {"layer": 1.5}]), "images[0]: layer is no integer"), (whole(images=[IMAGE | {"layer": -2}]), "ok"), (whole(images=[IMAGE | {"rotate": "ninety"}]), "images[0]: rotate is no number"), (whole(images=[IMAGE | {"rotate": -181}]), "images[0]: rotate is out of range"),
    ({"schema": contract.STAMPS[0], "texts": [TEXT]}, "texts: needs the newest schema"), (whole(texts=[TEXT | {"h": 1}]), "texts[0]: has an unknown key"), (whole(texts=[TEXT | {"text": 0}]), "texts[0]: text is blank"), (whole(texts=[TEXT | {"text": "x" * 61}]), "texts[0]: text is over 60 letters"),
    (whole(texts=[TEXT | {"x": None}]), "texts[0]: x is no number"), (whole(texts=[TEXT | {"y": 2}]), "texts[0]: y is out of range"), (whole(texts=[TEXT | {"size": 11}]), "texts[0]: size is out of range"), (whole(texts=[TEXT | {"color": 5}]), "texts[0]: color is no #RRGGBB"),
    (whole(texts=[TEXT | {"stroke": "red"}]), "texts[0]: stroke is unknown"), (whole(texts=[TEXT | {"fx": "spin"}]), "texts[0]: fx is unknown"), (whole(texts=[TEXT | {"font": "Arial"}]), "texts[0]: font is unknown"), (whole(texts=[TEXT, TEXT | {"rotate": 200}]), "texts[1]: rotate is out of range"),
    (whole(clips=[CLIP], subtitles=[LINE], tts=[CUE], images=[IMAGE], texts=[TEXT]), "ok"),
]


def test_one_failing_document_a_rule(spark):
    got = told(spark, [json.dumps(d) for d, _ in CASES])
    assert [(d, r) for (d, _), r in zip(CASES, got)] == CASES
    assert [plain(d) for d, _ in CASES] == [r for _, r in CASES]
    broken = {re.sub(r"\[\d+\]", "[]", r).replace(": ", "|", 1) for _, r in CASES}
    for section, _, _, _, _, _, _, _, reason in contract.RULES:  # every section has failing documents of its own
        assert any(b.startswith(section.replace("~", "") + "|") for b in broken), (section, reason)
    assert told(spark, ["{", None, "", '{"schema": "edit_overrides/v3"']) == ["document: is no object"] * 4


def test_random_documents_against_a_plain_walk(spark):
    rnd = random.Random(11)
    odd = [None, "", " ", "x", -1, 0, 1, 2.5, 181, 500, True, False, [], {}, [1], {"a": 1}, "3", "#FFFFFF", "hook", "none", "a.png", "../a.png"]

    def bent(value):
        value = json.loads(json.dumps(value))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            at = value
            while True:
                keys = list(at) if isinstance(at, dict) else list(range(len(at))) if isinstance(at, list) else []
                if not keys:
                    break
                k = rnd.choice(keys)
                if isinstance(at[k], (dict, list)) and at[k] and rnd.random() < 0.85:
                    at = at[k]
                    continue
                action = rnd.random()
                if action < 0.7:
                    at[k] = rnd.choice(odd)
                elif isinstance(at, dict) and action < 0.85:
                    del at[k]
                elif isinstance(at, dict):
                    at[rnd.choice(["size", "rotate", "layer", "color", "style", "role", "w", "other", "stroke", "source_time_sec"])] = rnd.choice(odd)
                break
        return value

    style = {"size": 3, "y": 0.5, "color": "#00ff00", "rotate": 3}
    base = {"schema": V3, "title": {"top_title": "t", "segments": [PART, PART | {"start_sec": 3, "end_sec": 5}]}, "clips": [CLIP, CLIP | {"role": "hook"}], "subtitles": [LINE, LINE | {"style": style, "source_time_sec": 2}],
            "tts": [CUE | {"duration_sec": 2}], "images": [IMAGE | {"layer": 1, "rotate": 3}], "texts": [TEXT | {"size": 20, "color": "#123456", "stroke": "dark", "fx": "pop", "font": "Griun", "rotate": 1}]}
    docs = []
    for _ in range(900):
        doc = bent({k: v for k, v in base.items() if k == "schema" or rnd.random() < 0.6})
        if isinstance(doc, dict) and rnd.random() < 0.15:
            doc["schema"] = rnd.choice(contract.STAMPS)
        docs.append(doc)
    got = told(spark, [json.dumps(d) for d in docs])
    want = [plain(d) for d in docs]
    assert [(d, a, b) for d, a, b in zip(docs, got, want) if a != b] == []
    assert len(set(want)) > 60


def test_all_violations_and_strictness(spark):
    bad = json.dumps(whole(clips=[CLIP | {"role": "x", "end_sec": 0}], texts=[TEXT | {"x": 2, "y": 2}]))
    docs = spark.createDataFrame([(1, bad), (2, json.dumps(whole(clips=[CLIP])))], "id long, document string")
    got = {(r.section, r.pos, r.reason) for r in contract.violations(docs, "id").collect()}
    assert got == {("clips[]", 0, "times are turned"), ("clips[]", 0, "role is unknown"), ("texts[]", 0, "x is out of range"), ("texts[]", 0, "y is out of range")}
    assert [r.id for r in contract.accepted(docs, "id", strict=False).collect()] == [2]
    with pytest.raises(Exception, match="times are turned"):
        contract.accepted(docs, "id").collect()
    assert contract.accepted(docs.where("id = 2"), "id").columns == docs.columns


def test_what_documents_change(spark):
    doc = whole(
        title={"top_title": "  new\nname "}, clips=[{"start_sec": 10, "end_sec": 20}, {"start_sec": 100, "end_sec": 101.0005, "role": "payoff", "subtitle": 7, "use_original_audio": False, "pacing_note": "slow"}],
        subtitles=[LINE, LINE | {"text": " a ", "source_time_sec": 1.25, "style": {"size": "64", "color": "#ffdd00"}}],
        tts=[{"source_time_sec": 9, "text": " late "}, {"source_time_sec": 5.5, "text": "near", "voice": "", "duration_sec": 2}, {"source_time_sec": 4, "text": "own", "voice": "deep", "speed": "fast"}],
        texts=[TEXT, TEXT | {"size": 12.5, "color": "#ffdd00", "fx": "pop", "rotate": "3"}],
    )
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(whole(title={"top_title": "t"}))), (3, json.dumps(whole(tts=[])))], "id long, document string")
    old = "id long, clip_idx int, start_ms long, end_ms long, subtitle string, use_original_audio boolean, pacing_note string, chunk_index int, candidate_index int, character_focus array<string>"
    olds = spark.createDataFrame([(1, 0, 0, 14_000, "zero", True, "n0", 3, 4, ["a"]), (1, 1, 14_000, 18_000, "one", False, "n1", 5, 6, None), (1, 2, 18_000, 22_000, "two", True, "n2", 7, 8, None)], old)
    got = contract.clips(docs, olds, "id", ["character_focus"]).orderBy("clip_idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, "build", 10_000, 20_000, "zero", True, "n0", 3, 4, ["a"]), (1, 1, "payoff", 100_000, 101_001, "7", False, "slow", -1, -1, None)]
    shown = spark.createDataFrame([(i, v, f"old{v}") for i in (1, 2, 3) for v in (0, 1)], "id long, variant_id int, title string")
    assert sorted(map(tuple, contract.variants(shown, docs, "id").collect())) == [(1, 0, "new\nname", True), (1, 1, "old1", False), (2, 0, "t", False), (2, 1, "old1", False), (3, 0, "old0", False), (3, 1, "old1", False)]
    lines = contract.subtitles(docs, "id").orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.source_ms, r.style and tuple(r.style)) for r in lines] == [(0, 2000, "said", None, None), (0, 2000, "a", 1250, (64.0, None, "#ffdd00", None))]
    drawn = contract.texts(docs, "id").orderBy("idx").collect()
    assert [(r.size, r.color, r.stroke, r.fx, r["rotate"], r.font) for r in drawn] == [(72, "#FFFFFF", "dark", "none", 0.0, "Jalnan"), (12, "#FFDD00", "dark", "pop", 3.0, "Jalnan")]
    cue = "id long, old_idx int, source_ms long, dur_ms long, voice string, speed string, chunk_index int, candidate_index int"
    cues = spark.createDataFrame([(1, 0, 5000, 1000, "a", "slow", 1, 1), (1, 1, 6000, 1500, "b", "", 2, 2), (1, 2, 10_001, 1, "c", "slow", 3, 3), (3, 0, 0, 1, "a", "slow", 1, 1)], cue)
    got = [tuple(r)[1:] for r in contract.cues(docs, cues, "id").orderBy("place").collect()]
    # Both neighbours of 5.5 s are equally near: the last one counts. 4 s is a second from 5 s: near enough.
    assert got == [(0, "own", 4000, 1000, "deep", "fast", 1, 1), (1, "near", 5500, 2000, "b", "normal", 2, 2), (2, "late", 9000, 3000, "ko_female", "normal", -1, -1)]


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "id long, document string, reason string")
    assert contract.first_violation(docs, "id").collect() == []
    extra = spark.createDataFrame([(1, "{}", "mine")], "id long, document string, section string")
    assert contract.accepted(extra, "id", strict=False).count() == 0 and contract.first_violation(extra.withColumn("fields", F.lit(1)), "id").count() == 1
