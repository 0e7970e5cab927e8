"""Best-fit packing: tokenised documents into as few fixed-length training sequences as possible.

One pass tokenises whole texts and keeps a row a piece (its length and a checksum of its ids), so the
packing itself moves a few bytes a document. Pieces of full length are sequences by themselves. The
others are dealt at random into groups of about GROUP pieces; each group is packed by vector best-fit
decreasing: a bin has residual capacity in tokens, documents and attention cost (sum of squared
lengths), and an item goes to the bin, among those it fits in every dimension, with the smallest
weighted residual norm (or the largest weighted dot product). A group wastes less than one sequence,
so groups cost under one sequence in thousands.

Words repeat, and this tokenizer splits at blanks before anything else, so each task keeps the ids of
words it has met (two generations of bounded dictionaries); a text's ids are its words' ids in a row.

Defined results: null texts count as empty and give one piece, the end token alone; very long texts
give many pieces; repeated rows are packed each; null ids stay null; an empty table gives none.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .textblock import all_blocks

LENGTH, END, GROUP = 4096, 1, 20_000
#: Tokens, documents, attention cost: what a sequence holds, and how much each counts in the score.
CAPACITY = (LENGTH, LENGTH, LENGTH * LENGTH)
SCALES = (1.0, 0.1, 0.1)
KNOWN, KNOWN_CHARS = 800_000, 16_000_000  # words in a generation, and their characters: some 320 MB for a worker's two


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _stays_a_letter(char: str) -> bool:
    """Whether the tokenizer's normal form ends in a letter too where a word ends in this one: the Latin letters
    do but for U+0130, which is lowered to two characters. Of others nothing is assumed."""
    return char.isalpha() and char < "\u0250" and char != "\u0130"


class WordIds:
    """Little-endian 32-bit ids of words, by a BPE file that marks word ends with </w>."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or word_file())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0  # of the young generation's words
        self.most = KNOWN  # words in a generation

    def _one_by_one(self, parts: list[str]) -> dict[str, bytes]:
        got = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(parts, got, strict=True)}

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """Parts that are letters only go to the tokenizer in one string, cut again at word ends."""
        out = self._one_by_one([p for p in parts if not p.isalpha()])
        plain = [p for p in parts if p.isalpha()]
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            if len(cut) == len(some) and cut[-1:] == [len(data)]:
                out.update(zip(some, (data[a:z] for a, z in zip([0, *cut], cut, strict=False)), strict=True))
            else:
                out |= self._one_by_one(some)
        return out

    def learn(self, words: set[str]) -> None:
        """Make words known; they stand in the young generation afterwards."""
        if len(self.young) > self.most or self.chars * KNOWN > KNOWN_CHARS * self.most:
            self.young, self.old, self.chars = {}, self.young, 0
        self.chars += sum(map(len, words))
        young, old, split = self.young, self.old, []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            # A run of points and commas after a letter is a token group of its own; ASCII letters are lowered anyway.
            core = w.rstrip(".,")
            if not core or not _stays_a_letter(core[-1]):
                core = w
            split.append((w, core.lower() if core.isascii() and core.isalpha() else core, w[len(core) :]))
        wanted = {p for x in split for p in x[1:] if p}
        known = {p: young[p] for p in wanted if p in young}
        known |= self._encode([p for p in wanted if p not in known])
        known[""] = b""
        for w, core, tail in split:
            young[w] = known[core] + known[tail] if tail else known[core]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        self.young[""] = b""
        found = list(map(self.young.get, words))
        if missing := {w for w, ids in zip(words, found, strict=True) if ids is None}:
            self.learn(missing)
            get = self.young.get
            found = [ids if ids is not None else get(w) for w, ids in zip(words, found, strict=True)]
        ends = list(accumulate(map(len, split)))
        return [b"".join(found[a:z]) for a, z in zip([0, *ends], ends, strict=False)]


_loaded: dict[str | None, WordIds] = {}


def word_ids(tokenizer: str | None) -> WordIds:
    """The process' own; a worker keeps it from task to task."""
    if tokenizer not in _loaded:
        _loaded[tokenizer] = WordIds(tokenizer)
    return _loaded[tokenizer]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None, known: int = KNOWN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): whole texts, cut only where longer than a sequence. known: words that a
    worker keeps of a generation, between tasks too; it changes memory and time only."""
    small_batches(docs.sparkSession)
    last, step = np.array([end], "<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        words.most = known
        row = TaskContext.get().partitionId() << 33
        for part in all_blocks(batches):
            out: dict[str, list[int]] = {"doc": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, ids in enumerate(words.ids([t or "" for t in part.column("text").to_pylist()])):
                ids += last
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    out["doc"].append(i)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
            n = len(out["doc"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(out["doc"], pa.int64())), pa.array(out["piece"], pa.int32())]
                + [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
                + [pa.array(range(row, row + n), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )
            row += n

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
    )


def best_fit(lengths: np.ndarray, capacity: tuple[int, ...] = CAPACITY, scales: tuple[float, ...] = SCALES, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by vector best-fit in order of decreasing length.

    Open bins are kept by residual tokens. The search starts where tokens fit best and ends when no
    other bin's tokens can outdo the best score found, so few bins are looked at. An item that no empty
    bin can hold (its attention cost, say) gets a bin to itself."""
    if score not in ("norm", "dot"):
        raise ValueError(f"score is norm or dot, not {score}")
    c0, c1, c2 = map(float, capacity)
    w0, w1, w2 = scales
    left: list[tuple[int, int, int]] = []  # residuals of each bin
    used: list[int] = []
    by_tokens: list[tuple[int, int]] = []  # (residual tokens, bin), ascending
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    least = int(lengths.min(initial=0))
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        cost = n * n
        first = bisect.bisect_left(by_tokens, (n, -1))
        best, chosen = None, -1
        for k in range(first, len(by_tokens)) if score == "norm" else range(len(by_tokens) - 1, first - 1, -1):
            tokens, b = by_tokens[k]
            if score == "norm":
                bound = w0 * ((tokens - n) / c0) ** 2
            else:
                bound = -(w0 * n * tokens / (c0 * c0) + w1 / c1 + w2 * cost / c2)
            if best is not None and bound >= best:
                break
            _, docs, attention = left[b]
            if docs < 1 or attention < cost:
                continue
            if score == "norm":
                points = bound + w1 * ((docs - 1) / c1) ** 2 + w2 * ((attention - cost) / c2) ** 2
            else:
                points = -(w0 * n * tokens / (c0 * c0) + w1 * docs / (c1 * c1) + w2 * cost * attention / (c2 * c2))
            if best is None or points < best:
                best, chosen = points, k
        if chosen >= 0:
            tokens, b = by_tokens.pop(chosen)
            _, docs, attention = left[b]
        else:
            b, (tokens, docs, attention) = len(left), capacity
            left.append(capacity)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left[b] = (tokens - n, docs - 1, attention - cost)
        if tokens - n >= least and docs > 1:
            bisect.insort(by_tokens, (tokens - n, b))
    return bins, offsets


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None,
         capacity: tuple[int, ...] | None = None, scales: tuple[float, ...] = SCALES, score: str = "norm", group: int = GROUP, known: int = KNOWN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    limits = capacity or (length, length, length * length)
    cut = settle(pieces(docs, doc_id, text, length, end, tokenizer, known), "pieces")
    groups = max(1, -(-cut.where(F.col("length") < length).count() // group))
    dealt = cut.withColumn("part", F.when(F.col("length") < length, F.pmod(F.xxhash64("row"), F.lit(groups))))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(frame["length"].to_numpy(), limits, scales, score)
        return frame.assign(sequence_id=frame["part"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns=["part", "row"])

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = [c.split()[0] for c in shape.split(", ")]
    small = dealt.where("part is not null").groupBy("part").applyInPandas(lambda f: fill(f)[columns], shape)
    # Full pieces: a sequence each, numbered past the groups.
    whole = dealt.where("part is null").withColumns({"sequence_id": F.lit(groups << 32) + F.col("row"), "offset": F.lit(0).cast("long")})
    return small.unionByName(whole.select(*columns))
