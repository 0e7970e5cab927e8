import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from spanwise.llm import toxicity as t
from spanwise.llm.common import settle

from .data import corpus, frame


def labelled_corpus(n=900):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    bad = ["vile", "Rotten!", "éscoria"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = " ".join(rnd.choice(bad) if toxic and rnd.random() < 0.06 else rnd.choice(words) for _ in range(rnd.randint(60, 200)))
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled_corpus()
    got = {r.doc_id: r for r in t.scored(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    toxic = {i: y for i, _, y in labels}
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    rows, labels = labelled_corpus(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    kinds = "doc_id long, quality int, toxic int"
    a, b = ({r.doc_id: r.score for r in t.scored(frame(spark, rows), spark.createDataFrame(x, kinds)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark):
    kinds = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], kinds)
    assert {r.score for r in t.scored(frame(spark), none).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 1)], kinds)
    assert t.scored(frame(spark), odd).count() == len(corpus())
    assert t.scored(frame(spark, empty=True), none).count() == 0
    model = t.Model(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.array([1.0, 0, 0, 0, 0]))
    assert model.score(pa.array([None, "", "x y"])).tolist() == [0.5] * 3


def plain(text):
    """The symbols of a text, and the place of the first that counts."""
    words = re.findall(rb"[a-z\x80-\xff]+", re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "").encode())
    return b" " * (t.ORDER - 1) + b"".join(w + b" " for w in words), t.ORDER - 1


class Brute:
    """Interpolated Kneser-Ney by the definitions, with dictionaries."""

    def __init__(self, rows):
        self.n = {c: [collections.Counter() for _ in range(t.ORDER + 1)] for c in (0, 1)}
        for text, toxic in rows:
            x, first = plain(text)
            for i in range(first, len(x)):
                for n in range(1, t.ORDER + 1):
                    self.n[toxic][n][x[i - n + 1 : i + 1]] += 1
        self.ratio = max(1.0, sum(self.n[0][1].values()) / sum(self.n[1][1].values()))
        once = lambda o: 1 - (1 - 1 / self.ratio) ** o
        top = t.ORDER
        # counts and distinct masses of both classes, by order
        self.k, self.d = {1: {}, 0: {}}, {1: {}, 0: {}}
        for n in range(t.SHARED + 1, top + 1):
            grams = set(self.n[0][n]) | set(self.n[1][n])
            if n == top:
                self.k[1][n] = {g: self.n[1][n][g] for g in grams}
                self.k[0][n] = {g: self.n[0][n][g] / self.ratio for g in grams}
                self.d[0][n] = {g: once(self.n[0][n][g]) for g in grams}
            else:
                self.k[1][n], self.k[0][n] = collections.Counter(), collections.Counter()
                for g in set(self.n[0][n + 1]) | set(self.n[1][n + 1]):
                    self.k[1][n][g[1:]] += self.n[1][n + 1][g] > 0
                    self.k[0][n][g[1:]] += once(self.n[0][n + 1][g])
                self.d[0][n] = {g: min(1, x) for g, x in self.k[0][n].items()}
            self.d[1][n] = {g: int(x > 0) for g, x in self.k[1][n].items()}
        self.both = {n: collections.Counter(g[1:] for g in set(self.n[0][n + 1]) | set(self.n[1][n + 1])) for n in range(1, t.SHARED + 1)}
        self.sums = {}
        for c in (0, 1):
            for name, table in (("k", self.k), ("d", self.d)):
                for n, x in table[c].items():
                    self.sums[name, c, n] = collections.Counter()
                    for g, v in x.items():
                        self.sums[name, c, n][g[:-1]] += v
        self.off = {n: self.discount(x.values()) for n, x in self.k[1].items()} | {n: self.discount(x.values()) for n, x in self.both.items()}
        self.whole = sum(self.both[1].values()) + 0.5 * len(self.both[1])
        self.of = {}
        for n, x in self.both.items():
            self.of[n] = (collections.Counter(), collections.Counter())
            for g, v in x.items():
                self.of[n][0][g[:-1]] += v
                self.of[n][1][g[:-1]] += 1

    @staticmethod
    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one and two else 0.75

    def shared(self, g):
        if len(g) == 1:
            return (self.both[1][g] + 0.5) / self.whole
        n, (s, c) = len(g), self.of[len(g)]
        d = self.off[n]
        return max(self.both[n][g] - d, 0) / s[g[:-1]] + min(max(d * c[g[:-1]] / s[g[:-1]], 1e-6), 1) * self.shared(g[1:])

    def known(self, g):
        return len(g) <= t.SHARED or g in self.k[1][len(g)]

    def left(self, c, g):
        n, lead = len(g), g[:-1]
        s = self.sums["k", c, n][lead]
        d = self.off[n]
        return min(max(d * self.sums["d", c, n][lead] / s, 1e-6), 1) if s else 1.0

    def p(self, c, g):
        if len(g) == t.SHARED:
            return self.shared(g)
        n = len(g)
        d = self.off[n]
        s = self.sums["k", c, n][g[:-1]]
        return max(self.k[c][n][g] - d * self.d[c][n][g], 0) / max(s, 1e-9) + self.left(c, g) * self.p(c, g[1:])

    def ratio_of(self, g):
        """Log ratio, and that of the longest known n-gram alone."""
        if len(g) == t.SHARED:
            return 0.0, 0.0
        if self.known(g):
            r = math.log(self.p(1, g) / self.p(0, g))
            return r, r
        r, alone = self.ratio_of(g[1:])
        return r + math.log(self.left(1, g) / self.left(0, g)), alone

    def score(self, text):
        x, first = plain(text)
        found = [self.ratio_of(x[i - t.ORDER + 1 : i + 1]) for i in range(first, len(x))]
        return len(found), sum(r for r, _ in found), sum(max(a - t.TELLING, 0) for _, a in found)


@pytest.mark.parametrize("most", [10**6, 300, 0])
def test_log_ratios_against_brute_force(spark, most):
    """However many n-grams are looked up and how many joined."""
    rows, labels = labelled_corpus(60)
    rows += [(60, "Été É été; vile vile. ÀÉÎ ß x", *rows[0][2:]), (61, None, *rows[0][2:]), (62, "...", *rows[0][2:]), (63, "vile", *rows[0][2:]), (63, "vile", *rows[0][2:])]
    of = {i: y for i, _, y in labels} | {60: 1, 63: 0}
    train = [(i, text, of[i]) for i, text, *_ in rows if of.get(i) is not None and i % 5]
    brute = Brute([(text, y) for _, text, y in train])
    model = t.learn(spark.createDataFrame(train, "doc_id long, text string, toxic int"), most)
    assert (model.rest is None) == (most == 10**6) and len(model.codes) <= max(most, 1)
    got = t.summed(frame(spark, rows).select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    texts = {i: text for i, text, *_ in rows}
    for r in got:
        n, ratio, telling = brute.score(texts[r.doc_id])
        assert r.sums[0] == n
        # Every one of at most four rounded terms a place is within half a millionth.
        assert abs(r.sums[1] / t.UNIT - ratio) <= 4e-6 * n + 1e-9 and abs(r.sums[2] / t.UNIT - telling) <= 4e-6 * n + 1e-9


def test_codes_of_long_texts_come_in_slices(monkeypatch):
    monkeypatch.setattr(t, "SLICE", 64)
    texts = pa.array(["a b", None, "word " * 300, "", "x" * 1000])
    doc, code = (np.concatenate(x) for x in zip(*t.Codes(texts)))
    want = [(d, int.from_bytes(plain(s)[0][i - t.ORDER + 1 : i + 1], "big")) for d, s in enumerate(texts.to_pylist()) for i in range(plain(s)[1], len(plain(s)[0]))]
    assert list(zip(doc.tolist(), code.tolist())) == want


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**48, 5000).astype(np.uint64))
    find = t.Lookup(keys[::2])
    assert find(keys).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(keys))]
    assert t.Lookup(keys[:0])(keys).tolist() == [-1] * len(keys)


def test_rare_expressions_count(spark, monkeypatch):
    """Scores are the same whether n-grams are looked up or joined."""
    rows, labels = labelled_corpus(600)
    rows = [(i, text + (f" slur{'abcdefghij'[i % 10]}" if labels[i][2] else ""), *more) for i, text, *more in rows] + [rows[5]]
    docs, of = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    near = {r.doc_id: r.score for r in t.scored(docs, of).collect()}
    for most, few in ((200, 10**6), (0, 0)):
        monkeypatch.setattr(t, "GRAMS", most)
        monkeypatch.setattr(t, "FEW", few)
        assert near == {r.doc_id: r.score for r in t.scored(docs, of).collect()}
    assert len(set(near.values())) > 500


def test_pipeline(spark, tmp_path):
    rows = corpus(3, 60)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, counts = {r[0] for r in rows}, []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)), "stage")
        if name != "packing":
            assert out.dtypes == docs.dtypes
        assert {r.doc_id for r in out.collect()} <= ids
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[2] > 0 and counts[3] > counts[2] and counts[4] >= counts[3]
    direct = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, direct)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())
