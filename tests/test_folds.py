"""Order-dependent scans against plain scans of whole sources, and results worked out by hand."""

from __future__ import annotations

import random

import pytest

from spanwise.operators import documents, folds, graph
from spanwise.operators.folds import SENTENCE_ENDS, _iou

SPANS = "source_id long, cand_idx long, chunk long, start_ms long, end_ms long, score long"


def spans(seed, sources=4, rows=60, wide=20_000, long=900):
    rnd = random.Random(seed)
    out = []
    for s in range(sources):
        for i in range(rows):
            a = rnd.randrange(0, wide)
            out.append((s, i, a // 4000, a, a + rnd.choice([0, rnd.randrange(1, long), rnd.randrange(1, 5 * long)]), rnd.randrange(9)))
    return out


def by_source(rows):
    for s in sorted({r[0] for r in rows}):
        yield s, [dict(zip(("source_id", "cand_idx", "chunk", "start_ms", "end_ms", "score"), r)) for r in rows if r[0] == s]


def test_greedy_dedup_replaces_in_place(spark):
    rows = [(1, 0, 0, 100, 1), (1, 1, 10, 100, 5), (1, 2, 60, 160, 9), (1, 3, 12, 100, 2), (1, 4, 5, 5, 0), (2, 5, 0, 100, 1)]
    df = spark.createDataFrame(rows, "source_id long, cand_idx long, start_ms long, end_ms long, score long")
    got = folds.greedy_dedup(df, ["source_id"], "cand_idx", 0.7).collect()
    # 1 takes the slot of 0, and 3 is absorbed by it; 4 is empty and meets nothing; sources do not meet.
    assert [r.cand_idx for r in sorted(got, key=lambda r: (r.source_id, r.slot))] == [1, 4, 2, 5]


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_greedy_dedup_equals_a_whole_scan(spark, least):
    rows = spans(1)
    want = set()
    for s, own in by_source(rows):
        kept = []
        for r in sorted(own, key=lambda r: (r["start_ms"], r["end_ms"], r["cand_idx"])):
            at = next((i for i, k in enumerate(kept) if _iou(r, k) >= least), None)
            if at is None:
                kept.append(r)
            elif r["score"] > kept[at]["score"]:
                kept[at] = r
        want |= {(s, r["cand_idx"], i) for i, r in enumerate(kept)}
    got = folds.greedy_dedup(spark.createDataFrame(rows, SPANS), ["source_id"], "cand_idx", least).collect()
    assert {(r.source_id, r.cand_idx, r.slot) for r in got} == want


def test_cover_dedup_equals_a_whole_scan(spark):
    """By milliseconds: a clip loses what earlier kept ones cover."""
    rows = spans(2, 3, 40, 30_000, 2500)
    want = set()
    for s, own in by_source(rows):
        covered, place = set(), 0
        for i, r in enumerate(own):
            a, z = r["start_ms"], r["end_ms"]
            if any(x["start_ms"] <= a and z <= x["end_ms"] and x["end_ms"] - x["start_ms"] > z - a for x in own[i + 1 :]):
                want.add((s, i, a, z, place))
                place += 1
                continue
            pieces, run = [], None
            for t in range(a, z + 1):
                free = t < z and t not in covered
                if free and run is None:
                    run = t
                if not free and run is not None:
                    pieces.append((run, t))
                    run = None
            best = max(pieces, key=lambda p: p[1] - p[0], default=None)
            if best and best[1] - best[0] >= 1500:
                want.add((s, i, *best, place))
                place += 1
                covered |= set(range(*best))
    got = folds.cover_dedup(spark.createDataFrame(rows, SPANS), ["source_id"], "cand_idx").collect()
    assert {(r.source_id, r.cand_idx, r.start_ms, r.end_ms, r.new_idx) for r in got} == want


def test_boundary_aliases_equal_a_whole_scan(spark):
    rows = spans(3, 3, 50)
    want = set()
    for s, own in by_source(rows):
        own = [r | {"alias": -1} for r in own]
        present = sorted({r["chunk"] for r in own})
        for one, two in zip(present, present[1:]):
            for a in (r for r in own if r["chunk"] == one):
                for b in (r for r in own if r["chunk"] == two):
                    both = min(a["end_ms"], b["end_ms"]) - max(a["start_ms"], b["start_ms"])
                    shorter = min(a["end_ms"] - a["start_ms"], b["end_ms"] - b["start_ms"])
                    if both > 0 and (both >= 0.5 * shorter or both >= 1500):
                        b["start_ms"], b["end_ms"] = min(a["start_ms"], b["start_ms"]), max(a["end_ms"], b["end_ms"])
                        a["alias"] = b["cand_idx"]
        want |= {(s, r["cand_idx"], r["start_ms"], r["end_ms"], r["alias"]) for r in own}
    got = folds.boundary_aliases(spark.createDataFrame(rows, SPANS), ["source_id"], "chunk", "cand_idx").collect()
    assert {(r.source_id, r.cand_idx, r.start_ms, r.end_ms, r.alias_of) for r in got} == want


def cues(seed, n=80):
    rnd = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 40, 200, 260, 600, 3000]) - rnd.choice([0, 0, 300])
        length = rnd.choice([50, 400, 1500])
        out.append((1 + (i > n // 2), i, max(0, t), max(0, t) + length, rnd.choice(["가요", "go on", "go on", "stop.", "and so", "la la la la", " ", "x" * 30])))
        t += length
    return out


CUE = "source_id long, seg_idx long, start_ms long, end_ms long, text string"


def test_pack_words_equals_a_whole_scan(spark):
    rows = cues(4)
    want = []
    for s in (1, 2):
        out, cue = [], None
        for _, _, a, z, text in (r for r in rows if r[0] == s):
            word = text.strip()
            if not word:
                continue
            if cue and (a - cue[1] >= 500 or z - cue[0] > 6000 or len(cue[2]) + 1 + len(word) > 44):
                out.append(cue)
                cue = None
            cue = (a, z, word) if cue is None else (cue[0], max(cue[1], z), f"{cue[2]} {word}")
            if word[-1] in ".!?…":
                out.append(cue)
                cue = None
        out += [cue] if cue else []
        want += [(s, i, *c) for i, c in enumerate(c for c in out if c[1] > c[0])]
    got = folds.pack_words(spark.createDataFrame(rows, CUE), ["source_id"], "seg_idx").collect()
    assert sorted((r.source_id, r.cue_idx, r.start_ms, r.end_ms, r.text) for r in got) == sorted(want)


def repeated(text):
    return any(text[i : i + n] == text[i + n : i + 2 * n] == text[i + 2 * n : i + 3 * n] for n in range(2, 21) for i in range(len(text) - 3 * n + 1) if text[i : i + n].strip())


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_pack_segments_equals_a_whole_scan(spark, seed):
    rows = cues(seed) + [(1, 500, 100, 900, "go on"), (1, 501, 104, 903, "go on"), (1, 502, 103, 899, "go on")]
    want = []
    for s in (1, 2):
        own = [(a, z, t.strip()) for k, _, a, z, t in rows if k == s and t.strip() and not repeated(t.strip())]
        seen, once = set(), []
        for a, z, t in own:
            if ((a + 5) // 10, (z + 5) // 10, t) not in seen:
                seen.add(((a + 5) // 10, (z + 5) // 10, t))
                once.append([a, z, t])
        kept = []
        for a, z, t in sorted(once, key=lambda x: x[:2]):
            same = next((k for k in kept if k[2] == t and a < k[1] and k[0] < z), None)
            if same:
                same[0], same[1] = min(same[0], a), max(same[1], z)
            else:
                kept.append([a, z, t])
        kept.sort(key=lambda x: x[:2])
        calm, i = [], 0
        while i < len(kept):
            j = i
            while j < len(kept) and kept[j][2] == kept[i][2]:
                j += 1
            calm += kept[i:j] if j - i <= 2 else [[kept[i][0], kept[j - 1][1], kept[i][2]]] if j - i <= 4 else []
            i = j
        out = []
        for a, z, t in sorted(calm, key=lambda x: x[:2]):
            if out:
                c = out[-1]
                limit = 44 if c[2].endswith(SENTENCE_ENDS) else 57
                if max(0, a - c[1]) <= 250 and len(c[2]) + 1 + len(t) <= limit and (c[1] - c[0] < 600 or max(z, c[1]) - c[0] <= 6000):
                    out[-1] = [c[0], max(c[1], z), f"{c[2]} {t}"]
                    continue
            out.append([a, z, t])
        want += [(s, i, *c) for i, c in enumerate(out)]
    got = folds.pack_segments(spark.createDataFrame(rows, CUE), ["source_id"]).collect()
    assert sorted((r.source_id, r.cue_idx, r.start_ms, r.end_ms, r.text) for r in got) == sorted(want)


FIT = "source_id long, clip long, role string, start_ms long, end_ms long, score long, cand_start long, cand_end long"


def fit(spark, rows, **how):
    df = spark.createDataFrame([(1, i, role, a, z, score, *more) for i, (role, a, z, score, *more) in enumerate(rows)], FIT)
    got = sorted(folds.fit_length(df, ["source_id"], "clip", 40_000, 59_700, **how).collect(), key=lambda r: r.clip)
    return [(r.role, r.start_ms, r.end_ms) for r in got], all(r.fits for r in got)


def test_fit_length(spark):
    none = (None, None)
    got, fits = fit(spark, [("payoff", 960_000, 1_020_240, 0, *none)])
    assert fits and got[0][2] == 1_020_240 and got[0][1] > 960_000  # a payoff keeps its end
    assert fit(spark, [("hook", 0, 25_000, 0, *none), ("payoff", 100_000, 130_000, 0, *none)]) == ([("hook", 0, 25_000), ("payoff", 100_000, 130_000)], True)
    four = [("hook", 809_440, 825_000, 0, *none), ("build", 929_200, 948_830, 0, *none), ("build", 957_700, 961_800, 0, *none), ("payoff", 966_548, 987_038, 0, *none)]
    got, fits = fit(spark, four, pinned=True)
    assert len(got) == 4 and fits
    assert len(fit(spark, four)[0]) == 3
    # Too short: the last clip grows to its candidate's end, then the first to its candidate's start.
    got, fits = fit(spark, [("hook", 50_000, 60_000, 0, 30_000, 70_000), ("payoff", 100_000, 110_000, 0, 90_000, 115_000)])
    assert (got, fits) == ([("hook", 35_000, 60_000), ("payoff", 100_000, 115_000)], True)
    assert fit(spark, [("hook", 0, 10_000, 0, *none)])[1] is False


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "cand_idx long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    got = {r.cand_idx: r.root for r in graph.components(nodes, edges, "cand_idx").collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(40)}


def test_rules_are_trimmed_and_distinct(spark):
    df = spark.createDataFrame([([" a", "b", "a "], ["b ", " ", "c"]), (None, ["x"])], "base array<string>, extra array<string>")
    got = [r.m for r in df.select(documents.merge_rules(df["base"], df["extra"]).alias("m")).collect()]
    assert got == [["a", "b", "c"], ["x"]]
