"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanwise.llm import importance_resampling, periodic_runs, queries, simhash_trees, spans
from spanwise.llm.textblock import Block

from .data import DOCS, corpus, frame

AZ = {i: i + 32 for i in range(65, 91)}
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def written(spark, tmp_path, rows, extra=None):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet")) if rows else spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(extra or ["the tharan 42 éou", None, "erst in in IN"])], "item_id long, text string")
    target.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


# --- hashes of spans


def test_span_hashes_equal_the_libraries():
    rnd = random.Random(1)
    data = np.frombuffer(rnd.randbytes(4000), np.uint8)
    starts = np.array([rnd.randrange(4000) for _ in range(2000)])
    ends = np.minimum(4000, starts + np.array([rnd.choice([0, 1, 3, 4, 7, 8, 9, 12, 31, 32, 33, 40, 63, 64, 65, 255, 256, 257, 900]) for _ in starts]))
    assert spans.xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(starts, ends)]
    assert spans.crc32(data, starts, ends).tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends)]
    none = np.zeros(0, np.int64)
    assert len(spans.xxh64(data, none, none)) == len(spans.crc32(data, none, none)) == 0


def test_gapless_words_stay_inside_documents():
    words = spans.Gapless(Block(pa.array(["A  b", "c\t\nD ", None, "", " e", "f"])))
    text = words.bytes.tobytes().decode()
    assert [text[s:e] for s, e in zip(words.starts, words.ends)] == list("abcdef")
    first, doc = words.grams(2)
    assert [text[words.starts[i] : words.ends[i + 1]] for i in first] == ["a b", "c d"] and doc.tolist() == [0, 1]


# --- op11


def plain_fingerprint(text):
    words = re.findall(BLANK_WORD, (text or "").translate(AZ))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """marks: (doc_id, fingerprint); smallest id reachable."""
    root = {d: d for d, _ in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(marks):
        for b, g in marks[:i]:
            if (f ^ g).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def long_copies(seed, n):
    """Long texts and copies with a few words changed, whose fingerprints differ by some bits."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(900)]
        for _ in range(4):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = "other"
            rows.append(" ".join(text))
    return rows


def test_op11_against_brute_force(spark, tmp_path):
    rows = corpus(5)
    rows += [(1000 + i, t, "en", "x", 0) for i, t in enumerate(long_copies(2, 25))]
    got = queries.op11_simhash_trees(spark, written(spark, tmp_path, rows)).collect()
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints.items()}
    expected = plain_components(list(prints.items()))
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len({p for d, p in prints.items() if d >= 1000}) > len({c for d, c in expected.items() if d >= 1000})  # near, unequal fingerprints


@pytest.mark.parametrize("tight", [False, True])
def test_trees_find_every_link(spark, monkeypatch, tight):
    """Dense balls, chains and strays, in many shards, parts and leaves."""
    if tight:
        for name, value in (("SAMPLE", 128), ("LEAST", 2), ("SHARD", 8), ("PART", 6), ("LEAF", 2)):
            monkeypatch.setattr(simhash_trees, name, value)
    rnd = random.Random(4)
    values = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    centre = rnd.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    values |= {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = simhash_trees.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert all(0 < (values[place[r.a]] ^ values[place[r.b]]).bit_count() <= 3 for r in found)
    label = list(range(len(values)))
    for r in found:
        a, b = label[place[r.a]], label[place[r.b]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    expected = plain_components(list(enumerate(values)))
    assert {i: x for i, x in enumerate(label)} == expected


def test_op11_shared_and_null_ids_and_no_rows(spark):
    one, two, far = long_copies(7, 3)[0], long_copies(8, 1)[0], long_copies(9, 1)[0]
    rows = [(5, one, None, None, None), (5, two, None, None, None), (9, two, None, None, None), (None, far, None, None, None), (2, far, None, None, None), (7, one, None, None, None), (7, one, None, None, None)]
    got = simhash_trees.marked(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (2, 2), (5, 5), (5, 5), (7, 5), (7, 5), (9, 5)]
    kept = simhash_trees.one_of_each(frame(spark, rows).withColumn("simhash_gone", F.lit(1)))
    assert kept.columns[-1] == "simhash_gone" and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 5, 5]
    assert simhash_trees.marked(frame(spark, empty=True)).collect() == []
    assert simhash_trees.marked(frame(spark, rows[:1])).collect()[0].component_id == 5


# --- op12


def plain_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_planted(doc_id, text):
    words = re.findall(BLANK_WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def periodic_texts(seed=3):
    rnd = random.Random(seed)
    out = ["a " * 200, "a b " * 77 + "a", "a b a a b " * 30, "x y z\n" * 4, "one two three four five six " * 2, "a b c d e f a b c d e", ""]
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out.append(" ".join(fib[-1]))
    thue = "a"
    for _ in range(9):
        thue += thue.translate(str.maketrans("ab", "ba"))
    out.append(" ".join(thue))
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 6)):
            piece = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))]
            words += piece * rnd.choice([1, 1, 2, 3, 5])
            words += [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
        out.append(" ".join(words))
    return out


def test_runs_against_a_plain_scan():
    texts = periodic_texts()
    block = periodic_runs.examined(pa.array(texts)).to_pylist()
    for text, got in zip(texts, block, strict=True):
        words = re.findall(BLANK_WORD, text)
        runs = plain_runs(words)
        assert list(zip(got["starts"], got["lengths"], got["periods"])) == runs, text
        assert got["collapsed"] == plain_collapsed(words, runs) and got["n_words"] == len(words)


def test_runs_with_deceiving_hashes(monkeypatch):
    """All words hash alike: every run is then found by direct comparison."""
    monkeypatch.setattr(periodic_runs.Extensions, "_valued", lambda self: np.ones(len(self.ids), np.uint64))
    texts = [t for t in periodic_texts(6) if len(t) < 500]
    for text, got in zip(texts, periodic_runs.examined(pa.array(texts)).to_pylist(), strict=True):
        assert list(zip(got["starts"], got["lengths"], got["periods"])) == plain_runs(re.findall(BLANK_WORD, text)), text


@pytest.mark.parametrize("least", [3, 8, 25])
def test_runs_of_other_lengths(least):
    for text, got in zip(periodic_texts(least), periodic_runs.examined(pa.array(periodic_texts(least)), least).to_pylist(), strict=True):
        assert list(zip(got["starts"], got["lengths"], got["periods"])) == plain_runs(re.findall(BLANK_WORD, text), least)


def test_op12_against_brute_force(spark, tmp_path):
    rows = corpus(6) + [(5000 + i, t, "en", "x", 0) for i, t in enumerate(periodic_texts(9))] + [(None, "a b " * 20, None, None, None), (5001, "a b " * 20, None, None, None)]
    rows.append((31, "u v w " * 20_000 + " ".join(f"k{i}" for i in range(5000)), None, None, None))  # 31: left as it is
    got = queries.op12_periodic_runs(spark, written(spark, tmp_path, rows)).collect()
    expected = []
    for doc_id, text, *_ in rows:
        words = plain_planted(doc_id, text)
        runs = [(0, 60_000, 3)] if len(words) == 65_000 else plain_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        collapsed = hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        expected.append((doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest, collapsed))
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in expected)


def test_runs_keep_columns_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b " * 9, None, None, None)]).withColumn("Periodic", F.lit("mine"))
    out, name = periodic_runs.found(docs)
    assert name.lower() != "periodic" and out.columns[:-1] == docs.columns
    assert out.first().Periodic == "mine" and out.first()[name].collapsed == "a b"
    assert periodic_runs.found(frame(spark, empty=True))[0].collect() == []


# --- op13


def features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def plain_resampled(rows, target):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    source = collections.Counter(bucket(w) for r in rows for w in features(r[1]))
    wanted = collections.Counter(bucket(w) for t in target for w in features(t))
    S, T = sum(source.values()), sum(wanted.values())
    gain = lambda k: math.floor(1000 * math.log((wanted[k] + 1) * (S + 10000) / ((source[k] + 1) * (T + 10000))))
    out = []
    for doc_id, text, *_ in rows:
        own = features(text)
        weight = sum(gain(bucket(w)) for w in own) // max(1, len(own))
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", [1, 8])
def test_op13_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed, 200) + [(None, "th er an " * 30, None, None, None), (7000, "A" * 40_000 + " é-É_z0 " * 3, None, None, None), (7001, "th ER " * 200_000, None, None, None)]
    target = ["th er TH", None, "", "naïve ok 🙂 th an inin", "x" * 3000]
    got = queries.op13_importance_resampling(spark, written(spark, tmp_path, rows, target)).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampled(rows, target)


def test_resampling_longer_features_ties_and_empty_tables(spark):
    texts = ["One two  THREE", "", None, "één"]
    words, grams = [features(t) for t in texts], []
    for w in words:
        grams += [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    found = importance_resampling.counted(spark.createDataFrame([(t,) for t in texts], "text string"), gram=3)
    assert {k: int(found[k]) for k in np.flatnonzero(found)} == collections.Counter(zlib.crc32(g.encode()) % 10000 for g in grams)
    rows = spark.createDataFrame([(i, 20, 20, 0, s) for i, s in [(4, 9), (1, 9), (3, 9), (3, 9), (2, 10), (8, -1)]], "doc_id long, n_words long, n_features long, weight long, score long")
    drawn = importance_resampling.drawn(rows, percent=70).collect()
    assert sorted((r.rank, r.doc_id) for r in drawn if r["rank"]) == [(1, 2), (2, 1), (3, 3), (4, 3)] and len(drawn) == 6
    empty = frame(spark, empty=True)
    assert importance_resampling.resampled(empty, empty).collect() == []
    some = frame(spark, [(i, f"w{i} " * 20, None, None, None) for i in range(20)])
    assert sorted(r["rank"] for r in importance_resampling.resampled(some, empty).collect() if r["rank"]) == [1, 2]
