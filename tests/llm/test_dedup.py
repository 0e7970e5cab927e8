"""Substring, line and near dedup against brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanwise.llm import common, line_dedup, near_dedup, substring_dedup
from spanwise.llm.textblock import Block

from .data import corpus, frame


def test_substring_dedup(spark):
    rows = corpus()
    first = {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k : k + 50]), i)
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark)).collect()}
    removed = 0
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        gone = {j for k in range(len(words) - 49) if first[tuple(words[k : k + 50])] < i for j in range(k, k + 50)}
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), len(gone), hashlib.sha256(kept).hexdigest()), i
        assert got[i].kept.encode() == kept
    assert removed > 500


def test_substring_dedup_edges(spark):
    assert substring_dedup.dedup(frame(spark, empty=True)).count() == 0
    rows = [(None, "a " * 60, None, None, None), (1, "b " * 60, None, None, None), (1, "b " * 60, None, None, None)]
    got = substring_dedup.dedup(frame(spark, rows)).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0]
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(i, t, None, None, None) for i, t in [(1, a), (5, a), (5, b), (5, b + " " + a), (7, b)]]
    got = {(r.doc_id, r.kept, r.n_removed) for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert got == {(1, a, 0), (5, "", 80), (5, b, 0), (5, b, 80), (7, "", 80)}
    long = " ".join(f"{i}" for i in range(200_000))
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, [(1, long, None, None, None), (2, "x " + long[: len(long) // 2], None, None, None)])).collect()}
    assert got[1].n_removed == 0 and got[2].n_words - got[2].n_removed <= 2


def test_substring_dedup_hot_keys(spark, monkeypatch):
    want = sorted((r.doc_id, r.kept_sha256) for r in substring_dedup.dedup(frame(spark)).collect())
    for keys in (3, 10**9):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted((r.doc_id, r.kept_sha256) for r in substring_dedup.dedup(frame(spark)).collect()) == want


def test_minimisers_are_leftmost():
    values = np.array([3, 1, 1, 2, 0, 5], np.uint64)
    best, at = substring_dedup.smallest(values, 3)
    assert best.tolist() == [1, 1, 0, 0] and at.tolist() == [1, 1, 4, 4]


def brute_windows(bare, run=3, words=50):
    n, count = len(bare), [len(x.encode().split()) for x in bare]
    for s in range(n):
        if s + run <= n:
            yield s, run, 0
        for few in range(1, run):
            if s + few <= n and sum(count[s : s + few]) >= words:
                yield s, few, 0
                break
    if 0 < n < run:
        yield 0, n, 1


def brute_lines(rows, run=3):
    seen, out = set(), {}
    for i, text, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        bare = [lines[k].strip(" \t\x0b\x0c\r") for k in filled]
        gone = set()
        for s, n, kind in sorted(brute_windows(bare, run)):
            key = (kind, *bare[s : s + n])
            if key in seen:
                gone |= {filled[j] for j in range(s, s + n)}
            seen.add(key)
        out[i] = (len(filled), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark):
    rand = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{x}" for x in rand.integers(0, 500, n))
    one, two = say(60), f"{say(30)}\n  {say(25)} "
    rows = corpus() + [(200 + i, "\n".join([say(8), x, say(9), "", say(3)]), None, None, None) for i, x in enumerate([one, two, one, two, two.replace("\n", "\n\n"), say(70)])]
    rows += [(300, "short one", None, None, None), (301, " short one\t\n", None, None, None), (302, "short one\nshort two", None, None, None), (303, "short one\n\nshort two", None, None, None)]
    want = brute_lines(rows)
    assert [want[i][1] for i in (200, 202, 203, 204, 205, 300, 301, 302, 303)] == [0, 1, 2, 2, 0, 0, 1, 0, 2]
    out, names = line_dedup.dedup(frame(spark, rows))
    got = {r.doc_id: (r[names["n_lines"]], r[names["n_removed"]], r.text) for r in out.collect()}
    for i, text, *_ in rows:
        assert got[i] == (want[i] if text is not None else (0, 0, None)), i
    assert sum(x[1] for x in got.values()) > 40


def test_line_matches_are_maximal(spark):
    body = [f"line {i}" for i in range(40)]
    rows = [(1, "\n".join(["a", *body[:30]])), (2, "\n".join(["b", "c", *body[4:20], "d", *body[:3], "e"])), (3, "\n".join(["f", *body[18:40]])), (4, "\n".join(["g", *body[25:40]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.matches(docs).drop("tx", "first_tx").collect()}
    # 4 repeats lines that both 1 and 3 have (25 to 29: the first place is in 1), and ones that only 3 has.
    assert got == {(2, 2, 18, 1, 5), (2, 19, 22, 1, 1), (3, 1, 13, 1, 19), (4, 1, 6, 1, 26), (4, 4, 16, 3, 11)}


def test_line_dedup_hot_keys(spark, monkeypatch):
    """The same result whether keys are hot, and joined by a broadcast, or not."""
    want = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark))[0].collect()}
    for keys in (3, 10**9):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert {r.doc_id: r.text for r in line_dedup.dedup(frame(spark))[0].collect()} == want


def test_line_dedup_edges(spark):
    assert line_dedup.without_repeats(frame(spark, empty=True)).count() == 0
    clash = frame(spark).withColumns({c: F.lit(1) for c in ("n_lines", "n_removed", "_id", "tx", "line_dedup_id", "line_dedup_gone", "s", "first", "hs")})
    out = line_dedup.without_repeats(clash)
    assert out.columns == clash.columns and out.where("doc_id = 140 or doc_id is null").count() == 1
    rows = [(None, "a\nb\nc\nd", None, None, None)] * 2
    assert line_dedup.without_repeats(frame(spark, rows)).where("text = 'a\nb\nc\nd'").count() == 2
    long = "\n".join(f"{i} " + "x" * (i % 7) for i in range(20_000))
    rows = [(1, long, None, None, None), (2, "head\n" + long, None, None, None), (2, "head\n" + long, None, None, None)]
    assert sorted(r.text for r in line_dedup.without_repeats(frame(spark, rows)).collect()) == [long, "head", "head"]


def brute_classes(rows, idf, least=0.8):
    parent, sets, seen = {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for i, text, *_ in rows:
        parent[i] = i
        if not (text or "").encode().split():
            continue
        if text in seen:
            join(seen[text], i)
            continue
        seen[text] = i
        _, found, weight = near_dedup.shingles(Block(pa.array([text])), idf)
        sets[i] = dict(zip(found.tolist(), weight.tolist()))
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for h in s:
            by[h].append(i)
    for a, b in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        x, y = sets[a], sets[b]
        both = sum(min(x[h], y[h]) for h in x.keys() & y.keys())
        if both >= least * (sum(x.values()) + sum(y.values()) - both):
            join(a, b)
    low = {}
    for i in parent:
        low[find(i)] = min(low.get(find(i), i), i)
    return {i: low[find(i)] for i in parent}


def test_near_dedup(spark):
    rows = corpus()
    docs = frame(spark)
    want = brute_classes(rows, near_dedup.word_idf(docs))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 15
    kept = {r.doc_id for r in near_dedup.one_of_each(docs).collect()}
    assert kept == set(want.values())


def test_near_dedup_chain_of_copies(spark):
    """A class held together by links between neighbours only, beside a leader that most of it fails."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(0, k):
            words[(7 * j) % 100] = f"n{j}"
        rows.append((k, " ".join(words), None, None, None))
    want = brute_classes(rows, near_dedup.word_idf(frame(spark, rows)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == want


def test_near_dedup_compares_large_buckets_in_blocks(spark, monkeypatch):
    """The same classes when buckets are compared in blocks of two members."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "FEW", 0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        words = list(base)
        for j in range(k // 3):
            words[(7 * j + k % 3) % 60] = f"n{j}{k % 3}"
        rows.append((k, " ".join(words), None, None, None))
    rows += corpus()[:60]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    want = brute_classes(rows, near_dedup.word_idf(frame(spark, rows)))
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()} == want


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    found = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weight = rng.uniform(1, 9, 400)
    a, b = slice(0, 300), slice(60, 360)
    signs = [near_dedup.signatures(np.zeros(300, int), found[s], weight[s], 1000)[1][0] for s in (a, b)]
    true = near_dedup.weighted_jaccard((found[a], weight[a]), (found[b], weight[b]))
    assert abs((signs[0] == signs[1]).mean() - true) < 0.06


def test_near_dedup_edges(spark):
    assert near_dedup.classes(frame(spark, empty=True)).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (4, None, None, None, None), (5, "", None, None, None)]
    got = sorted(near_dedup.classes(frame(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.class_id) for r in got] == [(None, None), (3, 3), (3, 3), (4, 4), (5, 5)]
    clash = frame(spark, rows).withColumns({c: F.lit(0) for c in ("class_id", "_gone", "near_dedup_gone", "sha", "head", "root")})
    assert near_dedup.one_of_each(clash).columns == clash.columns


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (4, 1), (20, 20)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 10: 8} or got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8}
