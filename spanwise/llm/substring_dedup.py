"""Substring dedup: words covered by a 50-word window that an earlier document also has.

Rabin-Karp prefix sums give the hash of every window of `width` words. To shuffle few of them, each
window names an anchor: the smallest hash of the shorter spans inside it, chosen by content alone, so
equal windows name equal anchors. Anchors (about 1 word in 14) are counted first; only windows whose
anchor occurs in two different texts can repeat, and only those are hashed with 128 bits (two hashes,
each over its own word hashes), counted and joined to their first document. Repeated windows merge into maximal removal intervals.

Exact copies are recognised by a digest of the whole text first and judged once. No step gathers a
key's rows: counts are aggregated on the map side, then joined back, where adaptive execution splits
a hot key.

Defined results: null and empty texts, and texts of fewer words than a window, lose nothing; two
windows of one document do not count against each other; rows with a null id are returned unchanged;
rows that share an id count as one document, so they do not count against each other either, and each
text of them is judged for itself; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, settle, small_batches
from .textblock import BYTE_BASE_2, WORD_BASE, WORD_BASE_2, Block, all_blocks

WIDTH, SPAN = 50, 25


def smallest(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of n values: the smallest and its place, the leftmost of equals (by doubling)."""
    best, at, have = values, np.arange(len(values)), 1
    while have < n:
        step = min(have, n - have)
        left, right = best[: len(best) - step], best[step:]
        first = left <= right
        best, at = np.where(first, left, right), np.where(first, at[: len(at) - step], at[step:])
        have += step
    return best, at


def anchors(b: Block, hashes: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows; their anchors' hashes; the anchors' places."""
    if len(hashes) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    starts, _ = b.windows(hashes, width)
    every = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    span_starts, span_hash = b.windows(hashes, span)
    every[span_starts] = span_hash
    best, at = smallest(every, width - span + 1)
    return starts, best[starts], at[starts]


def intervals(words: int, starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals (end exclusive) of a document's words that the windows cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return [(int(a), min(words, int(z) + width)) for a, z in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]], strict=True)]


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, span: int = SPAN) -> DataFrame:
    """(doc_id, tx: xxhash64 of the text, at: first words of the windows that an earlier document has too). Texts
    without any are absent. Exact copies of an earlier text are listed with at = null: all their windows repeat."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            b = Block(part.column("text"))
            starts, best, at = anchors(b, b.word_hashes(), width, span)
            if len(at):
                new = np.r_[True, at[1:] != at[:-1]]
                doc = b.word_doc()[starts[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best[new].view(np.int64)), part.column("doc_id").take(pa.array(doc)), part.column("tx").take(pa.array(doc))], names=["h", "doc_id", "tx"]
                )

    known = settle(docs.select("doc_id", F.xxhash64("text").alias("tx"), F.sha2("text", 256).alias("sha")), "known")
    shas = settle(known.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shas")
    copies = join_hot(known, shas.drop("n"), ["sha"], shas, "n", known.count())
    copies = settle(copies.where("doc_id > first").select("doc_id", "tx").distinct(), "copies")
    marks = settle(docs.select("doc_id", "text", F.xxhash64("text").alias("tx")).mapInArrow(find, "h long, doc_id long, tx long"), "anchors")
    common = marks.groupBy("h").agg(F.min("tx").alias("a"), F.max("tx").alias("z"), F.count("*").alias("n")).where("a <> z").select("h", "n")
    common = settle(common, "common")
    own = ["doc_id", "tx"]
    wanted = join_hot(marks, common.select("h"), ["h"], common, "n", marks.count()).groupBy(*own).agg(F.collect_set("h").alias("hs"))
    suspects = docs.withColumn("tx", F.xxhash64("text")).join(wanted.join(copies, own, "left_anti"), own).select(*own, "text", "hs")

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            b = Block(part.column("text"))
            hashes = b.word_hashes()
            starts, best, _ = anchors(b, hashes, width, span)
            sets = part.column("hs")
            ends = np.asarray(sets.offsets)
            values = sets.values.to_numpy().view(np.uint64)
            border = np.searchsorted(starts, b.word_at)
            take = np.zeros(len(starts), bool)
            for i in range(b.n):
                here = slice(border[i], border[i + 1])
                take[here] = np.isin(best[here], values[ends[i] : ends[i + 1]])
            starts = starts[take]
            if len(starts):
                _, one = b.windows(hashes, width, WORD_BASE)
                _, two = b.windows(b.word_hashes(BYTE_BASE_2), width, WORD_BASE_2)
                one, two, doc = one[take], two[take], b.word_doc()[starts]
                # A document's equal windows are one row.
                order = np.lexsort((two, one, doc))
                one, two, doc, starts = one[order], two[order], doc[order], starts[order]
                new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1])])
                at = pa.ListArray.from_arrays(pa.array(np.r_[new, len(starts)].astype(np.int32)), pa.array((starts - b.word_at[doc]).astype(np.int32)))
                of = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), part.column("doc_id").take(of), part.column("tx").take(of), at],
                    names=["h1", "h2", "doc_id", "tx", "at"],
                )

    windows = settle(suspects.mapInArrow(hash_windows, "h1 long, h2 long, doc_id long, tx long, at array<int>"), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    firsts = settle(firsts, "firsts")
    later = join_hot(windows, firsts.select("h1", "h2", "first"), ["h1", "h2"], firsts, "n", windows.count()).where("doc_id > first")
    return later.groupBy(*own).agg(F.flatten(F.collect_list("at")).alias("at")).unionByName(copies.select(*own, F.lit(None).cast("array<int>").alias("at")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed: array of [from, to) words, kept: the words left, one blank apart)."""
    found = removals(docs, doc_id, text, width)
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # "copy" tells an exact copy (at is null) from a document without a removal.
    found = found.select("doc_id", "tx", "at", F.col("at").isNull().alias("copy"))
    joined = whole.withColumn("tx", F.xxhash64("text")).join(found, ["doc_id", "tx"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "removed": [], "kept": []}
            for text_, at, copy in zip(part.column("text").to_pylist(), part.column("at").to_pylist(), part.column("copy").to_pylist(), strict=True):
                words = (text_ or "").encode().split()
                gone = ([(0, len(words))] if len(words) >= width else []) if copy else intervals(len(words), np.array(at or [], np.int64), width)
                left, done = [], 0
                for a, z in gone:
                    left += words[done:a]
                    done = z
                kept = b" ".join(left + words[done:])
                out["n_words"].append(len(words))
                out["n_removed"].append(sum(z - a for a, z in gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed"].append([list(x) for x in gone])
                out["kept"].append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["removed"], pa.list_(pa.list_(pa.int32()))), pa.array(out["kept"], pa.string())],
                names=["doc_id", *out],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>, kept string")


def sql(width: int = WIDTH) -> str:
    """The query's rows by sorting every window as text."""
    return f"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - {width - 2})) as i from split where len(ws) >= {width})),
firsts as (
  select w, min(doc_id) as first from windows group by w),
gone as (
  select distinct doc_id, unnest(range(i, i + {width})) as p from windows join firsts using (w) where doc_id > first),
words as (
  select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from split),
marked as (
  select w.doc_id, x, w.p, g.p is not null as cut, lag(g.p is not null, 1, false) over (partition by w.doc_id order by w.p) as before
  from words w left join gone g on g.doc_id = w.doc_id and g.p = w.p),
kept as (
  select doc_id, count(*) as n_words, count(*) filter (where cut) as n_removed, count(*) filter (where cut and not before) as n_intervals,
         string_agg(x, ' ' order by p) filter (where not cut) as left_over from marked group by doc_id)
select s.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(left_over, '')) as kept_sha256, coalesce(n_intervals, 0)::bigint as n_intervals
from split s left join kept using (doc_id)"""
