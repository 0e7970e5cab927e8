"""Quality rules and the text blocks below them."""

import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanwise.llm import quality_rules as q
from spanwise.llm.textblock import Block

from .data import corpus, frame


def test_block_words_and_lines():
    texts = ["a b  c\n", None, "", " x", "y\nz q", "", "é\x0bb"]
    b = Block(pa.array(texts, pa.string()))
    assert [bytes(b.bytes[s:e]) for s, e in zip(b.starts, b.ends)] == [w for t in texts for w in (t or "").encode().split()]
    starts, ends, _ = b.line_spans()
    assert [bytes(b.bytes[s:e]) for s, e in zip(starts, ends)] == [x for t in texts for x in (t or "").encode().split(b"\n")]
    assert not len(Block(pa.array([], pa.string())).starts)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_match_brute_force(spark):
    out, name = q.counted(frame(spark))
    for r in out.collect():
        s = r[name]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute(r.text), r.doc_id


def test_label_model_keeps_clean_and_drops_junk(spark):
    rows = corpus()
    junk = [(1000 + i, " ".join(f"word{j}###" for j in range(90)), "en", "s", 0) for i in range(8)]
    shout = [(2000 + i, " ".join("LOUD%d!!" % j for j in range(90)), "en", "s", 0) for i in range(8)]
    clean = [r for r in rows if r[0] < 120 and len((r[1] or "").split()) >= 60]
    kept = {r.doc_id for r in q.keep(frame(spark, clean + junk + shout)).collect()}
    assert kept == {r[0] for r in clean}


def test_edges(spark):
    assert q.keep(frame(spark, empty=True)).count() == 0
    clash = frame(spark).withColumn("quality_counts", F.lit(1))
    assert q.keep(clash).columns == clash.columns
    model = q.fit(np.zeros((0, len(q.RULES))), np.zeros(0))
    assert 0 < model.prior < 1
