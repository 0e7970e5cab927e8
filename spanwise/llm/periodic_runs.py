"""Runs of words that repeat with a period, by Main-Lorentz on what repeated k-grams leave.

A run is a maximal stretch of words with smallest period q and a length of max(LEAST, 2 q) words at least.
Its first length - q words, OVERLAP or more, stand once more q words on, so every word of a run lies in an
OVERLAP-gram that occurs twice in its document (least of max(LEAST - q, q) over q, here six). Other words
are masked; a stretch of unmasked words is a segment, and no run leaves one. Segments are halved again and again
as Main and Lorentz do: a run that crosses a middle and has a period's words on one side of it shows as two
extensions, forwards and backwards, of that middle against the word a period away. All middles of a
level, in all segments of a block, are examined at once; a period is a candidate only if the word on the
middle's other side is equal too. Extensions compare polynomial hashes of words in a binary search, and
every run is then compared word by word; should a hash have deceived, the segment is done again by direct comparison.

Texts are read where they lie: no shuffle, and a task's memory follows its longest text.

Defined results: null, empty and wordless texts have no runs and collapse to the empty text; rows are judged
one by one, so repeated ids and rows are no special case; columns of the input stay, and new ones get names
that it does not have; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, small_batches
from .spans import Gapless
from .textblock import BYTE_BASE_2, WORD_BASE, WORD_BASE_2, Block, all_blocks, inverse, powers

#: Fewest words of a run, and so the fewest words that stand again a period on.
LEAST = 12
OVERLAP = min(max(LEAST - q, q) for q in range(1, LEAST + 1))

FOUND = "starts array<long>, lengths array<long>, periods array<long>, collapsed string, n_words long, runs_sha256 string"


def unmasked(block: Block, hashes: np.ndarray, k: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of words that lie in k-grams occurring twice or more in their document."""
    first, grams = block.windows(hashes, k, WORD_BASE_2)
    if not len(first):
        return first, first
    doc = block.word_doc()
    keys = (grams ^ (doc[first].astype(np.uint64) * np.uint64(WORD_BASE))) * np.uint64(BYTE_BASE_2)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = first[twice]
    marks = np.bincount(at, minlength=len(hashes) + 1) - np.bincount(at + k, minlength=len(hashes) + 1)[: len(hashes) + 1]
    covered = np.cumsum(marks)[: len(hashes)] > 0
    head = covered & np.r_[True, ~covered[:-1] | (doc[1:] != doc[:-1])]
    tail = covered & np.r_[~covered[1:] | (doc[1:] != doc[:-1]), True]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


class Extensions:
    """How far words from two places on, or back, are equal."""

    def __init__(self, ids: np.ndarray, direct: bool = False):
        self.ids, self.direct = ids, direct
        self.back = powers(inverse(WORD_BASE), len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(self._valued() * powers(WORD_BASE, len(ids)), out=self.sums[1:])

    def _valued(self) -> np.ndarray:
        values = (self.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(BYTE_BASE_2)
        return (values ^ (values >> np.uint64(29))) * np.uint64(WORD_BASE_2)

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and from b on, up to `most`."""
        if self.direct:
            return np.array([self._compared(self.ids[x : x + m] == self.ids[y : y + m]) for x, y, m in zip(a, b, most, strict=True)], np.int64)
        return self._searched(most, lambda n: self._span(a, a + n) == self._span(b, b + n))

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words that end at a and at b, those included, up to `most`."""
        if self.direct:
            return np.array([self._compared((self.ids[x + 1 - m : x + 1] == self.ids[y + 1 - m : y + 1])[::-1]) for x, y, m in zip(a, b, most, strict=True)], np.int64)
        return self._searched(most, lambda n: self._span(a + 1 - n, a + 1) == self._span(b + 1 - n, b + 1))

    def _span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    @staticmethod
    def _compared(same: np.ndarray) -> int:
        return int(len(same) if same.all() else same.argmin())

    @staticmethod
    def _searched(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = same(middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group, and 1, 2, .. within it, for groups of these sizes."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(1, len(of) + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def crossing(ext: Extensions, low: np.ndarray, middle: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of repetitions over the middles of [low, high), extended within [first, last)."""
    ids = ext.ids
    of, q = _within(high - middle)  # a period's words at least on the right
    m = middle[of]
    use = ids[m - 1] == ids[m + q - 1]
    of, q, m = of[use], q[use], m[use]
    ahead = ext.forward(m, m + q, np.maximum(last[of] - m - q, 0))
    behind = ext.backward(m - 1, m + q - 1, m - first[of])
    yield m - behind, m + q + ahead, q
    of, q = _within(middle - low)  # or on the left
    m = middle[of]
    use = ids[m] == ids[m - q]
    of, q, m = of[use], q[use], m[use]
    ahead = ext.forward(m - q, m, last[of] - m)
    behind = ext.backward(m - q - 1, m - 1, np.maximum(m - q - first[of], 0))
    yield m - q - behind, m + ahead, q


def _smallest(found: np.ndarray) -> np.ndarray:
    """Each stretch (start, end) once, with its smallest period: multiples of a run's period give the same stretch."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found


def runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray, least: int = LEAST, direct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run inside the segments [first, last) of word ids, by start and period."""
    ext = Extensions(ids, direct)
    low, high, found = first, last, []
    segment = np.arange(len(first))
    while len(low):
        middle = (low + high) // 2
        for start, end, q in crossing(ext, low, middle, high, first[segment], last[segment]):
            use = end - start >= np.maximum(least, 2 * q)
            found.append(_smallest(np.stack([start[use], end[use], q[use]], axis=1)))
        low, high, segment = np.r_[low, middle], np.r_[middle, high], np.r_[segment, segment]
        use = high - low >= least
        low, high, segment = low[use], high[use], segment[use]
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    every = _smallest(every)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    if not direct:
        wrong = [s for s, e, q in every.tolist() if not np.array_equal(ids[s : e - q], ids[s + q : e])]
        if wrong:
            bad = np.zeros(len(first), bool)
            bad[np.searchsorted(first, wrong, side="right") - 1] = True
            again = np.stack(runs(ids, first[bad], last[bad], least, direct=True), axis=1)
            every = np.concatenate([every[~bad[np.searchsorted(first, every[:, 0], side="right") - 1]], again])
            every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def examined(texts: pa.Array, least: int = LEAST) -> pa.RecordBatch:
    """FOUND for each text."""
    block = Block(texts)
    overlap = min(max(least - q, q) for q in range(1, least + 1))
    words = Gapless(block, lower=False)
    data, starts, ends = words.bytes.tobytes(), words.starts.tolist(), words.ends.tolist()
    first, last = unmasked(block, block.word_hashes(), overlap)
    ids = np.full(len(starts), -1, np.int64)  # only words of segments are looked at
    if len(first):
        of, at = _within(last - first)
        inside = first[of] + at - 1
        spans = zip(words.starts[inside].tolist(), words.ends[inside].tolist(), strict=True)
        ids[inside] = np.asarray(pa.array([data[s:e] for s, e in spans], pa.binary()).dictionary_encode().indices)
    start, end, q = runs(ids, first, last, least)
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, start + q, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[: len(starts)] == 0
    border = np.searchsorted(start, block.word_at)
    out: dict[str, list] = {name: [] for name in ("starts", "lengths", "periods", "collapsed", "n_words", "runs_sha256")}
    for i in range(block.n):
        a, z = int(block.word_at[i]), int(block.word_at[i + 1])
        own = slice(int(border[i]), int(border[i + 1]))
        s, length, period = (start[own] - a).tolist(), (end[own] - start[own]).tolist(), q[own].tolist()
        if not s:
            collapsed = data[starts[a] : ends[z - 1]] if z > a else b""
        else:
            collapsed = b" ".join(data[starts[k] : ends[k]] for k in (np.flatnonzero(kept[a:z]) + a).tolist())
        out["starts"].append(s)
        out["lengths"].append(length)
        out["periods"].append(period)
        out["collapsed"].append(collapsed.decode())
        out["n_words"].append(z - a)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{x},{y},{p}\n" for x, y, p in zip(s, length, period, strict=True)).encode()).hexdigest())
    longs = pa.list_(pa.int64())
    arrays = [pa.array(out[c], longs) for c in ("starts", "lengths", "periods")]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(out["collapsed"], pa.string()), pa.array(out["n_words"], pa.int64()), pa.array(out["runs_sha256"], pa.string())], names=list(out))


def found(docs: DataFrame, text: str = "text", least: int = LEAST) -> tuple[DataFrame, str]:
    """docs with one more struct column, whose name is returned: FOUND of the text: starts, lengths and periods of its
    runs in words, the text without the repeats of each run, its number of words and the runs' digest."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "periodic")
    kind = f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"
    schema = docs.withColumn(name, F.lit(None).cast(kind)).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(len(batch.columns))])
            for part in all_blocks([plain], f"c{at}"):
                done = examined(part.column(at), least)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(done.columns, names=done.schema.names)], names=schema.names)

    return docs.mapInArrow(run, schema), name


def longest(column: Column) -> Column:
    """(start, length, period) of a text's longest run; of equal ones the first, then the one of the smallest period."""
    each = F.arrays_zip(column.getField("starts").alias("start"), column.getField("lengths").alias("length"), column.getField("periods").alias("period"))
    ordered = F.transform(each, lambda r: F.struct((-r["length"]).alias("down"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ordered)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["down"]).alias("length"), best["period"].alias("period")))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, where the words of ids whose CRC-32 ends in 0 are made periodic from one place on."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    chosen = (F.pmod(mark, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    docs = docs.select("doc_id", "text", words.alias("words"), F.floor(mark / 10).cast("long").alias("g"), F.size(words).cast("int").alias("n"))
    docs = docs.withColumn("a", F.pmod("g", F.col("n")).cast("int"))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8)))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a"))), " ")
    return docs.select("doc_id", F.when(F.col("words").isNotNull(), text).otherwise(F.col("text")).alias("text"))
