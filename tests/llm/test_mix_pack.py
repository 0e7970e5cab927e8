import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import sequence_packing as p
from spanwise.llm import source_mixing as s

from .data import corpus, frame


def water(sizes, weights=(3, 1, 2), share=1.5, repeat=2):
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: weights[i % 3] for i, x in enumerate(order)}
    total, cap = share * sum(sizes.values()), {x: repeat * n for x, n in sizes.items()}
    fixed = set()
    while True:
        rest = [x for x in order if x not in fixed]
        level = (total - sum(cap[x] for x in fixed)) / max(1, sum(weight[x] for x in rest)) if rest else 0
        over = {x for x in rest if weight[x] * level > cap[x]}
        if not over:
            return {x: cap[x] if x in fixed else weight[x] * level for x in order}
        fixed |= over


def test_mix(spark):
    rows = corpus()
    out, names = s.mix(frame(spark))
    got = [(r.doc_id, r.source, *(r[names[c]] for c in ("size", "source_size", "target", "taken"))) for r in out.collect()]
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    sizes = collections.Counter()
    for i, _, _, source, _ in rows:
        sizes[source] += size[i]
    goal = water(sizes)
    taken = collections.Counter()
    for i, source, n, whole, target, k in got:
        assert n == size[i] and whole == sizes[source] and abs(target - goal[source]) < 1e-6 and 0 <= k <= 2 * n
        taken[source] += k
    for source in sizes:
        assert taken[source] == int(goal[source] + 1e-9)
    again, names = s.mix(frame(spark).repartition(3))
    assert sorted((r.doc_id, r[names["taken"]]) for r in again.collect()) == sorted((g[0], g[-1]) for g in got)


def test_mixed_rows(spark):
    out, names = s.mix(frame(spark))
    want = {r.doc_id: (r[names["taken"]], r.text) for r in out.collect()}
    mixed = s.mixed(frame(spark).withColumn("mix_taken", F.lit(1)))
    assert mixed.columns == [*frame(spark).columns, "mix_taken"]
    words = collections.Counter()
    for r in mixed.collect():
        n = len(r.text.encode().split())
        words[r.doc_id] += n
        assert r.text == want[r.doc_id][1] or r.text.split(" ") == [w.decode() for w in want[r.doc_id][1].encode().split()][:n]
    assert words == {i: k for i, (k, _) in want.items() if k}


def test_mix_edges(spark):
    assert s.mixed(frame(spark, empty=True)).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, "a", None), (None, "x y", None, "b", None)]
    out, names = s.mix(frame(spark, rows))
    assert {(r.doc_id, r[names["size"]]) for r in out.collect()} == {(1, 0), (2, 0), (None, 2)}


def test_equal_rows_share_the_cut(spark):
    rows = [(7, "a b c d e f g h i j", None, "a", None)] * 10 + [(i, "x y", None, "b", None) for i in range(1000)]
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("_cut", "mix_size", "mix_of_cut", "key", "place", "size", "target", "cut")})
    out, names = s.mix(clash)
    got = [(r.source, r[names["taken"]], r[names["target"]]) for r in out.collect()]
    taken = [x for source, x, _ in got if source == "a"]
    target = next(x for source, _, x in got if source == "a")
    assert len(set(taken)) == 1 and target - 10 < sum(taken) <= target
    assert s.mixed(clash).columns == clash.columns


def test_word_ids_equal_the_tokenizer():
    words = p.WordIds()
    odd = [
        "Don't  stop now", "İstanbul ΣΑΣ. é x가", "<|endoftext|> <|ENDOFTEXT|>, a<|startoftext|>b.", "x\x1cy\x0bz\r\n\t q", "'s,'t 've.",
        "...,, .a a.b,c. ½x² 12.5,", "日本語。テスト, ﬁ", "", " ", "ǅ Ⅷ. ﷺ á. É. ÉÀ, ​.", "a" * 500,
    ]
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert words.ids(odd) == want == words.ids(odd)


def test_word_ids_equal_the_tokenizer_on_random_strings():
    """Letters of many scripts, marks, digits, points, blanks of all kinds, and any other code point."""
    rnd = random.Random(7)
    often = "abcXYZ.,.,  \n\t'0129!?-<|>éÉßİıǅΣσςאبกकা가나日本ﬁﷺ\u0301\u0307\u200d\u00a0\u2028🙂𝒜½²Ⅷ"

    def char() -> str:
        if rnd.random() < 0.9:
            return rnd.choice(often)
        while 0xD800 <= (c := rnd.randrange(1, 0x110000)) < 0xE000:
            pass
        return chr(c)

    texts = ["İ.", "aİ,.", *("".join(char() for _ in range(rnd.randint(1, 12))) for _ in range(100_000))]
    words = p.WordIds()
    for i in range(0, len(texts), 5000):
        some = texts[i : i + 5000]
        want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert words.ids(some) == want


def test_long_words_do_not_fill_the_cache(monkeypatch):
    monkeypatch.setattr(p, "KNOWN_CHARS", 5000)
    words = p.WordIds()
    for i in range(20):
        words.ids([f"{i}" + "x" * 1000])
    assert sum(map(len, words.young)) + sum(map(len, words.old)) < 15_000


def test_pack(spark):
    rows = corpus()
    got = p.pack(frame(spark)).collect()
    words = p.WordIds()
    of = {(r.doc_id, r.piece): r for r in got}
    n = 0
    for (i, *_), e in zip(rows, words.tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            own, r = ids[at : at + 4 * 4096], of[i, k]
            assert (r.start, r.length, r.ids_crc32) == (at // 4, len(own) // 4, zlib.crc32(own))
            n += 1
    assert n == len(got)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(r.length for r in got) / 4096 + 2


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(score):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 400)
    capacity = (100, 4, 6000)
    bins, offsets = p.best_fit(lengths, capacity, (1.0, 0.5, 0.5), score)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4
        assert len(own) == 1 or (own.astype(int) ** 2).sum() <= 6000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(np.r_[0, own[np.argsort(offsets[bins == b])][:-1]]).tolist())
    assert len(set(bins.tolist())) < 320
    with pytest.raises(ValueError):
        p.best_fit(lengths, capacity, score="other")


def brute_norm(lengths, capacity, scales):
    left, bins = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        item = (n, 1, n * n)
        fits = [(sum(w * ((c - i) / full) ** 2 for w, c, i, full in zip(scales, b, item, capacity)), k) for k, b in enumerate(left) if all(c >= i for c, i in zip(b, item))]
        k = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(list(capacity))
        left[k] = [c - i for c, i in zip(left[k], item)]
        bins.append(k)
    return len(left)


def test_early_end_of_the_search_changes_nothing():
    rng = np.random.default_rng(2)
    for _ in range(5):
        lengths = rng.integers(1, 60, 120)
        capacity, scales = (100, 5, 4000), (1.0, 0.3, 0.2)
        assert len(set(p.best_fit(lengths, capacity, scales)[0].tolist())) == brute_norm(lengths, capacity, scales)


def test_pack_cuts_long_documents(spark):
    """A document of some 14,000 tokens, among others: pieces of 4,096 but for the last, every id once."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "engine", "stays", "naïve.", "x9", "日本"]) for _ in range(n)) for n in (9000, 30, 4095, 4096, 10)]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).withColumns({c: F.lit(1) for c in ("piece", "start", "row", "part", "length")})
    got = p.pack(docs).collect()
    tokenizer = p.WordIds().tokenizer
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, k * 4096, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert max(r.piece for r in got) >= 2


def test_pack_edges(spark):
    assert p.pack(frame(spark, empty=True)).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(1, "a b", None, None, None)]
    got = p.pack(frame(spark, rows), group=2).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 3), (True, 1), (True, 1), (True, 1)]
