"""The label model and every stage of the pipeline against plain forms of them, each stage on what the one before kept."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanwise.llm import line_dedup, near_dedup, quality_rules, queries, sequence_packing, source_mixing
from spanwise.llm.common import settle

from .data import corpus, frame
from .test_dedup import brute_classes

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) >= 0xC0
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in SYMBOLS for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
        "n_lines": len(lines), "n_distinct": len(set(words)), "n_letters": sum(map(letter, text)), "n_upper": sum("A" <= c <= "Z" for c in text), "n_alpha_words": sum(any(map(letter, w)) for w in words),
        "n_shouts": text.count("!"), "n_marked_words": sum(any(c in SYMBOLS for c in w) for w in words),
    }


def voted(n):
    """The ten rules, one condition for bad and one for good each."""
    w, letters, chars = n["n_words"], n["n_letters"], n["word_chars"]
    pairs = [
        (10 * n["n_symbols"] > w, 50 * n["n_symbols"] <= w), (2 * n["n_upper"] > letters, 10 * n["n_upper"] <= letters), (4 * n["n_shouts"] > w, 20 * n["n_shouts"] <= w),
        (100 * n["n_repeat_words"] > 30 * w, 100 * n["n_repeat_words"] <= 10 * w), (chars < 3 * w or chars > 10 * w, 4 * w <= chars <= 7 * w), (100 * n["n_dup_lines"] > 30 * n["n_lines"], n["n_dup_lines"] == 0 and n["n_lines"] >= 3),
        (w >= 50 and 100 * n["n_distinct"] < 15 * w, 100 * n["n_distinct"] >= 40 * w), (100 * n["n_marked_words"] > 30 * w, 100 * n["n_marked_words"] <= 2 * w), (100 * letters < 80 * chars, 100 * letters >= 90 * chars),
        (100 * n["n_alpha_words"] < 70 * w, 100 * n["n_alpha_words"] >= 90 * w),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in pairs]


def learned(votes, rounds=200):
    """Expectation-maximisation document by document: prior and each rule's chances of a bad vote in either class."""
    k = 10
    prior, g, b = 0.8, [0.02] * k, [0.4] * k

    def chance(v):
        odds = math.log(prior / (1 - prior))
        for x, gi, bi in zip(v, g, b):
            odds += math.log(gi / bi) if x == -1 else math.log((1 - gi) / (1 - bi)) if x == 1 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        p = [chance(v) for v in votes]
        new_g, new_b = [], []
        for r in range(k):
            of = [(v[r], x) for v, x in zip(votes, p) if v[r]]
            gi = (sum(x for v, x in of if v == -1) + 0.4) / (sum(x for _, x in of) + 20)
            bi = max((sum(1 - x for v, x in of if v == -1) + 8) / (sum(1 - x for _, x in of) + 20), gi)
            new_g.append(min(max(gi, 1e-4), 0.05))
            new_b.append(min(max(bi, 0.1), 0.98))
        prior, g, b = (sum(p) + 16) / (len(votes) + 20), new_g, new_b
    return chance


def plain_quality(rows):
    """(doc_id, base_failed, posterior) of every row."""
    every = [(i, counts(t)) for i, t, *_ in rows]
    failed = lambda n: n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
    chance = learned([voted(n) for _, n in every if not failed(n)])
    return [(i, failed(n), chance(voted(n))) for i, n in every]


def junky():
    rows = corpus(3, 80)
    junk = ["!!! WIN $$$ #1 <b> BUY NOW " * 20, "99 12 % & " * 40, "AAAA BBBB CCCC DDDD " * 30 + "word " * 5, "\n".join(["same old line of words here"] * 20), " ".join(f"{i}*" for i in range(90))]
    rows += [(900 + i, t + f" x{i}" * (i % 7), "en", "src1", 0) for i, t in enumerate(junk * 3)]
    rnd = random.Random(4)
    odd = ["#tag", "SHOUT", "stop!", "7", "a", "extraordinarily", "same", "é"]
    for i in range(60):
        strange = rnd.sample(odd, 3)
        words = [rnd.choice(strange) if rnd.random() < i / 70 else f"{rnd.choice('bcdfg')}{rnd.choice(['ora', 'intel', 'ubec'])}{rnd.choice('aeiou')}{chr(97 + k % 26)}" for k in range(90)]
        rows.append((2000 + i, "".join(w + rnd.choice([" ", " ", "\n"]) for w in words), "fr", "src2", 0))
    return rows


def test_posteriors_against_plain_expectation_maximisation(spark, tmp_path):
    rows = junky()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, str(tmp_path)).collect()}
    want = plain_quality(rows)
    assert len({round(p, 9) for _, f, p in want if not f}) > 5 and {p >= 0.5 for _, f, p in want if not f} == {True, False}
    for i, failed, p in want:
        assert got[i].base_failed == failed and got[i].posterior == pytest.approx(p, abs=1e-6)
        assert got[i].kept == (not failed and p >= 0.5)


def asked(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()}


def test_stages_against_plain_forms(spark, tmp_path):
    rows = [r for r in junky() if r[0] is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)

    good = settle(stages["quality rules"](spark, docs, sf), "quality")
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, f, p in plain_quality(rows) if not f and p >= 0.5)

    lines = settle(stages["line dedup"](spark, good, sf), "lines")
    told = asked(line_dedup.sql(), good)
    texts = {r.doc_id: r.text for r in lines.collect()}
    for i, r in told.items():
        if i in texts:
            assert hashlib.sha256(texts[i].encode()).hexdigest() == r["kept_sha256"]
        else:
            assert r["n_removed"] > 0 and r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(told) == good.count() and any(r["n_removed"] for r in told.values())
    assert lines.where(F.col("n_chars") != F.length("text")).isEmpty()

    own = [tuple(r) for r in lines.collect()]
    classes = brute_classes([(r[docs.columns.index("doc_id")], r[docs.columns.index("text")]) for r in own], near_dedup.word_idf(lines))
    single = settle(stages["near-duplicates"](spark, lines, sf), "near")
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values())) and len(set(classes.values())) < len(classes)

    mixed = settle(stages["source mixing"](spark, single, sf), "mixed")
    taken = {i: r["taken"] for i, r in asked(source_mixing.sql(), single).items() if r["taken"]}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(WORD, r.text or ""))
    assert words == taken

    packed = stages["packing"](spark, mixed, sf).collect()
    filled, ends = collections.defaultdict(list), collections.defaultdict(int)
    for r in packed:
        assert 0 < r.length <= 4096
        filled[r.sequence_id].append((r.offset, r.length))
        ends[r.doc_id] += r.length
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    tokens = collections.Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(sequence_packing.WordIds().tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert ends == tokens


def test_stages_of_an_empty_table(spark, tmp_path):
    frame(spark, empty=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert quality_rules.keep(frame(spark, empty=True)).collect() == []
