"""Importance resampling towards a target distribution, over hashed word features, by a vectorised byte automaton.

A table of 256 classes says which bytes of an Arrow UTF-8 buffer belong to words; word boundaries are the
places where the class changes; table-driven CRC-32 states advance through all words of a block at once.
A feature's bucket is its CRC modulo BUCKETS. The buckets of all documents and of all target texts are counted
(tasks count first; BUCKETS rows a table reach the driver), a bucket's gain is the smoothed log-ratio of its
shares in thousandths, and a document's weight is the mean gain of its features. With Gumbel noise from a
hash of the seed and the id, the highest scores are a sample without replacement by weight.

Ranks need no sort of all rows in one task: scores are whole numbers within bounds that logarithms of
counts and of 2**32 set (some ten thousands of different ones), so rows are counted by score, the counts are
summed from the top, and only rows that are drawn are numbered, among those of one score.

Defined results: null, empty and wordless texts have no features and weight 0; rows with a null id have a null
score, count as no document of the draw and are never drawn; rows that share id and score are drawn in any order among
each other; an empty table gives none, and an empty target makes every feature alike rare in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches
from .spans import CRC_POLYNOMIAL, Gapless, crc32
from .textblock import Block, all_blocks

BUCKETS, GRAM, SEED, FEWEST, PERCENT = 10_000, 1, 2024, 20, 10

#: Bytes of words once A-Z are lowered: digits, a-z and all bytes of other characters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def buckets(block: Block, gram: int = GRAM, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every feature: all runs of 1 to gram words."""
    words = Gapless(block)
    found, docs = [], []
    for n in range(1, gram + 1):
        first, doc = words.grams(n)
        found.append(crc32(words.bytes, words.starts[first], words.ends[first + n - 1]) % np.uint32(size))
        docs.append(doc)
    return np.concatenate(found).astype(np.int64), np.concatenate(docs)


def counted(texts: DataFrame, text: str = "text", gram: int = GRAM, size: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for part in all_blocks(batches):
            seen += np.bincount(buckets(Block(part.column("text"), OUTSIDE), gram, size)[0], minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of each bucket's smoothed shares, in thousandths, floored."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for part in all_blocks(batches):
            block = Block(part.column("text"), OUTSIDE)
            bucket, doc = buckets(block, gram, len(value))
            n = np.bincount(doc, minlength=block.n)
            total = np.zeros(block.n, np.int64)
            np.add.at(total, doc, value[bucket])
            arrays = [part.column("doc_id"), pa.array(np.diff(block.word_at)), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score: weight plus Gumbel noise in thousandths, from the hash of seed and doc_id."""
    mark = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((mark + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, fewest: int = FEWEST, percent: int = PERCENT) -> DataFrame:
    """rows (settled) with rank: 1, 2, .. of the percent of those with at least `fewest` words that score highest, by
    score downwards and doc_id; null for the others."""
    able = (F.col("n_words") >= fewest) & F.col("score").isNotNull()
    by_score = settle(rows.where(able).groupBy("score").agg(F.count("*").alias("n")), "scores")  # some ten thousand rows
    budget = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = by_score.select(F.col("score").alias("_score"), before.alias("_before")).where(F.col("_before") < budget)
    joined = rows.join(F.broadcast(cut), able & (F.col("score") == F.col("_score")), "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = joined.where("_before is not null").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= budget, F.col("rank")))
    rest = joined.where("_before is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_score", "_before")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank says what is drawn towards the target."""
    gain = gains(counted(docs, text, gram), counted(target, target_text, gram))
    return drawn(settle(scored(weighed(docs, gain, doc_id, text, gram), seed), "weights"))


def sql(size: int = BUCKETS, seed: int = SEED, fewest: int = FEWEST, percent: int = PERCENT) -> str:
    """The same over single words, with CRC-32 bit by bit in lists, for tables documents and benchmark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with tab as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, {CRC_POLYNOMIAL}) else c // 2 end)) as t),
d as (select row_number() over () as r, doc_id, {words} as w from documents),
b as (select {words} as w from benchmark),
of_docs as (select r, unnest(w) as w from d), of_target as (select unnest(w) as w from b),
known as (select w, hex(encode(w)) as x from (select w from of_docs union select w from of_target)),
hashed as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: cast('0x' || x[2 * i + 1 : 2 * i + 2] as bigint))), lambda c, z: xor(c // 256, t[xor(c % 256, z) + 1])), 4294967295) % {size} as k from known, tab),
s as (select k, count(*) as s from of_docs join hashed using (w) group by 1), t as (select k, count(*) as t from of_target join hashed using (w) group by 1),
totals as (select (select coalesce(sum(s), 0) from s)::double as ss, (select coalesce(sum(t), 0) from t)::double as tt),
gain as (select k, cast(floor(1000 * ln((coalesce(t, 0)::double + 1) * (ss + {size}) / ((s::double + 1) * (tt + {size})))) as bigint) as g from s left join t using (k), totals),
weights as (select r, count(*) as n, cast(floor(sum(g)::double / count(*)) as bigint) as weight from of_docs join hashed using (w) join gain using (k) group by 1),
scored as (select d.r, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || left(sha256('{seed}:' || doc_id), 8) as bigint) + 0.5) / 4294967296.0::double))) as bigint) as score from d left join weights w on d.r = w.r),
able as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= {fewest} and score is not null)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, cast(case when rank <= {percent} * n // 100 then rank end as bigint) as rank from scored left join able using (r)"""
