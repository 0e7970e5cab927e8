"""MinHash near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document is a weighted set of five-word shingles: weight = occurrences x mean IDF of the shingle's
words. (An IDF of the shingle itself would fall with every further copy, and with it the similarity of
large groups of near copies.) Document frequencies of words are counted over all documents in a table
of 2**16 hash buckets, so what is sent to executors has a fixed size.

ICWS draws one shingle per hash function with probability in proportion to weight, so two signatures
agree with the chance of their weighted Jaccard similarity. Its (r, c, beta) triples come from a fixed
pool of 2**16 that a hash of the shingle and the function points into. ROWS values make a band; in a
band's bucket every member is paired with the smallest document of the bucket and verified by the
exact weighted Jaccard similarity. Verified links form classes by alternating large-star and small-star
steps. Members of one bucket that are in different classes still are then compared with each other:
every pair is examined, unless the triangle inequality (the distance is a metric) or the weights rule a
link out. In buckets of up to SMALL members these are rows, at most SMALL a member; larger buckets are
compared in square blocks of bounded size that return links only, so rows are members and blocks there,
and the members of a bucket's largest class are sent to the blocks of the others alone.

Texts that are equal are one node. Bucket minima and classes are aggregates joined back: no bucket's
members are gathered or all paired.

Defined results: null and wordless texts are in a class of their own; texts of fewer than five words
have one shingle, all their words; rows with a null id get a null class; rows that share an id count
as one document if their texts link; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, small_batches
from .textblock import WORD_BASE, Block, all_blocks, mixed, span_hashes

SHINGLE, LEAST, BANDS, ROWS, BUCKETS = 5, 0.8, 12, 4, 1 << 16
#: Members, and bytes of their texts, of a block in which classes of one bucket are compared; buckets of
#: up to SMALL members are compared as pairs.
BLOCK, BLOCK_BYTES, SMALL = 128, 1 << 24, 24
#: Ids of texts in shared buckets go to every executor up to so many (8 MB); more are joined by a shuffle.
FEW = 1_000_000
_POOL = 1 << 16


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """1/r, r, ln c and beta of each triple: r and c are Gamma(2, 1), beta is uniform."""
    draw = np.random.Generator(np.random.PCG64(11))
    r, c, beta = draw.gamma(2.0, 1.0, _POOL), draw.gamma(2.0, 1.0, _POOL), draw.random(_POOL)
    return tuple(x.astype(np.float32) for x in (1 / r, r, np.log(c), beta))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(48)).astype(np.int64)


def shingles(b: Block, idf: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and weight of the distinct shingles of each document, by document and hash."""
    hashes = b.word_hashes()
    starts, found = b.windows(hashes, k)
    of = b.word_doc()
    doc = of[starts]
    sums = np.concatenate([[0.0], np.cumsum(idf[_bucket(hashes)])])
    mean = (sums[starts + k] - sums[starts]) / k
    words = np.diff(b.word_at)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        found = np.concatenate([found, span_hashes(hashes, b.word_at[short], b.word_at[short + 1], WORD_BASE)])
        doc = np.concatenate([doc, short])
        mean = np.concatenate([mean, (sums[b.word_at[short + 1]] - sums[b.word_at[short]]) / words[short]])
    if not len(found):
        return doc, found, mean
    order = np.lexsort((found, doc)) if b.n > 1 else np.argsort(found, kind="stable")
    doc, found, mean = doc[order], found[order], mean[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(found)])
    # Rounded, so that equal shingles have equal weights wherever they stand in a block's running sums.
    return doc[at], found[at], np.round(mean[at], 6) * times


def signatures(doc: np.ndarray, found: np.ndarray, weight: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and `count` sampled values for each."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[at, len(doc)])
    inverse, rate, log_c, beta = _pool_cached()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(at), count), np.uint64)
    group = np.repeat(np.arange(len(at)), sizes)
    for h in range(count):
        index = (found * np.uint64((0x9E3779B97F4A7C15 * (2 * h + 1)) & (1 << 64) - 1) >> np.uint64(48)).astype(np.int32)
        shift = beta.take(index)
        t = np.floor(log_w * inverse.take(index) + shift)
        key = log_c.take(index) - rate.take(index) * (t - shift + np.float32(1))
        best = np.minimum.reduceat(key, at)
        hit = np.flatnonzero(key == np.repeat(best, sizes))
        if len(hit) > len(at):  # of equal keys the smallest shingle hash, which comes first
            hit = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]
        out[:, h] = mixed(found[hit] + t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return doc[at], out


_cached: list = []


def _pool_cached():
    if not _cached:
        _cached.extend(_pool())
    return _cached


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    keys = np.zeros((len(values), values.shape[1] // rows), np.uint64)
    for i in range(values.shape[1]):
        keys[:, i // rows] = mixed(keys[:, i // rows] * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, i] + np.uint64(i // rows + 1))
    return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole > 0 else 0.0


def word_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)) of each hash bucket of words, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for part in all_blocks(batches):
            b = Block(part.column("text"))
            pairs = np.unique(_bucket(b.word_hashes()) + b.word_doc() * BUCKETS)
            seen[:BUCKETS] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            seen[BUCKETS] += b.n
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["bucket", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1)
    for r in counts.collect():  # at most BUCKETS + 1 rows
        df[r.bucket] = r.n
    return 1 + np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS]))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): the smallest node of its component."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = settle(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now = settle(small.distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = state


class Verifier:
    """Exact similarity of pairs (a, b) of documents' ids."""

    def __init__(self, texts: DataFrame, idf: np.ndarray, k: int = SHINGLE):
        self.texts, self.k = texts, k
        self.idf = texts.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers

    def __call__(self, pairs: DataFrame, what: str) -> DataFrame:
        idf, k = self.idf, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple = (None, None)
            for batch in batches:
                for part in all_blocks([batch], "text_b"):
                    out = np.zeros(part.num_rows)
                    doc, found, weight = shingles(Block(part.column("text_b")), idf.value, k)
                    at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    leaders = part.column("a").to_pylist()
                    for i in range(part.num_rows):
                        if last[0] != leaders[i]:
                            _, f, w = shingles(Block(part.column("text_a").slice(i, 1)), idf.value, k)
                            last = (leaders[i], (f, w))
                        out[i] = weighted_jaccard(last[1], (found[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]))
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out)], names=["a", "b", "s"])

        members = pairs.join(self.texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        joined = members.join(self.texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return settle(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, s double"), what)


def links(texts: DataFrame, heads: DataFrame, idf: np.ndarray, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b) with a < b and similarity of at least `least`, between the heads (doc_id) of texts (doc_id, text), by
    word_idf(). Enough for classes: links inside a class already found may be left out."""
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches, limit=1 << 19):
            doc, found, weight = shingles(Block(part.column("text")), shared.value)
            if len(doc):
                own, values = signatures(doc, found, weight, bands * rows)
                keys = band_keys(values, rows)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                size = pa.array(np.asarray(pa.compute.binary_length(part.column("text")))[own].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), arrays, size], names=["doc_id", "keys", "size"])

    # Signed where they lie, without a shuffle of texts; copies of a head's text are left out after that.
    signed = settle(texts.mapInArrow(sign, "doc_id long, keys array<long>, size long").join(heads, "doc_id", "left_semi"), "bands")
    member = signed.select(F.col("doc_id").alias("b"), F.posexplode("keys").alias("band", "key"))
    # Written before the join, so that both sides of it are dealt plainly and a hot key's rows can be split.
    leader = settle(member.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "leaders")
    inside = settle(member.join(leader, "key"), "inside")
    # Texts that share a bucket are all that is read from here on.
    met = settle(inside.select(F.col("b").alias("doc_id")).distinct(), "met")
    texts = settle(texts.join(F.broadcast(met) if met.count() <= FEW else met, "doc_id", "left_semi"), "texts")
    verify = Verifier(texts, idf)
    done = verify(inside.where("a <> b").select("a", "b").distinct(), "first")
    # A member's distance to its bucket's smallest document, for the triangle inequality below.
    near = inside.join(done, ["a", "b"], "left").select("key", "band", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("s")).alias("d"))
    near = settle(near, "near")
    good = done.where(F.col("s") >= least).select("a", "b")
    roots = components(good)
    now = near.join(roots, near["b"] == roots["id"], "left").select("key", "band", "b", "d", F.coalesce("root", "b").alias("root"))
    now = settle(now.join(signed.select(F.col("doc_id").alias("b"), "keys", "size"), "b"), "now")
    # A bucket's largest class needs no comparing within: its members meet those of the others only.
    of_root = now.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max_by(F.struct("root", "n", "size"), F.struct("n", "root"))
    parts = of_root.groupBy("key").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    sized = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("long")
    parts = parts.select("key", "n", F.col("main.root").alias("main"), sized(F.col("main.n"), F.col("main.size")).alias("blocks"), sized(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others"))
    left = settle(now.join(settle(parts, "parts"), "key").drop("size"), "left")

    # Small buckets: at most SMALL pairs a member, each in its first common band only.
    pool = left.where(F.col("n") <= SMALL)
    x, y = pool.alias("x"), pool.alias("y")
    may = (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - least + 1e-9) & (F.col("x.root") != F.col("y.root"))
    alike = F.zip_with(F.slice("x.keys", F.lit(1), F.col("x.band")), F.slice("y.keys", F.lit(1), F.col("x.band")), lambda a, b: a == b)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.b") < F.col("y.b")) & may & ~F.exists(alike, lambda k: k))
    pairs = pairs.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).join(done.select("a", "b"), ["a", "b"], "left_anti")
    good = good.unionByName(verify(pairs, "second").where(F.col("s") >= least).select("a", "b"))

    # Larger ones are compared in square blocks of bounded size; rows are members, not pairs.
    dealt = F.xxhash64("b", "key")
    inside = F.col("root") == F.col("main")
    block = F.when(inside, F.col("others") + F.pmod(dealt, F.col("blocks"))).otherwise(F.pmod(dealt, F.col("others")))
    met = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("blocks"))
    left = left.where(F.col("n") > SMALL).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "b", "d", "root", "keys")
    tasks = left.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").groupBy("key", "i", "j")
    more = tasks.applyInArrow(lambda group: compare_block(group, shared.value, least), "a long, b long")
    return settle(good.unionByName(more).distinct(), "links")


def compare_block(group: pa.Table, idf: np.ndarray, least: float) -> pa.Table:
    """Links (a, b) between members of one block pair that are in different classes; links inside a class
    that these links have joined already are left out."""
    ids, roots, band = (np.asarray(group.column(c)) for c in ("b", "root", "band"))
    distance, block = np.asarray(group.column("d")), np.asarray(group.column("block"))
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    keys = np.stack(group.column("keys").to_pylist())
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in all_blocks(group.select(["text"]).combine_chunks().to_batches()):
        doc, found, weight = shingles(Block(batch.column("text")), idf)
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        sets += [(found[x:y], weight[x:y]) for x, y in zip(at, at[1:], strict=False)]
    total = np.array([w.sum() for _, w in sets])
    own = np.unique(roots, return_inverse=True)[1]  # class numbers, joined as links are found
    out: list[tuple[int, int]] = []
    for i in range(len(ids)):
        rest = slice(i + 1, None)
        may = (own[rest] != own[i]) & (np.abs(distance[rest] - distance[i]) <= 1 - least + 1e-9)
        may &= np.minimum(total[rest], total[i]) >= least * np.maximum(total[rest], total[i]) * (1 - 1e-9)
        if across:
            may &= block[rest] != block[i]
        some = np.flatnonzero(may) + i + 1
        # Of a pair's common buckets only the first compares it.
        some = some[~(keys[some, : band[i]] == keys[i, : band[i]]).any(axis=1)]
        for j in some.tolist():
            if own[j] != own[i] and weighted_jaccard(sets[i], sets[j]) >= least:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                own[own == own[j]] = own[i]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) for every row: the smallest id of its near-duplicate class."""
    small_batches(docs.sparkSession)
    with_words = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    own = settle(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(with_words, F.sha2(text, 256)).alias("sha")), "shas")
    known = own.where("doc_id is not null and sha is not null")
    heads = settle(known.groupBy("sha").agg(F.min("doc_id").alias("head")), "heads")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    repeated = settle(own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        # Ids of several rows keep the text that they head, once.
        chosen = heads.groupBy("head").agg(F.min("sha").alias("sha")).withColumnRenamed("head", "doc_id").join(repeated, "doc_id", "left_semi")
        several = texts.join(chosen, "doc_id").where(F.sha2("text", 256) == F.col("sha")).select("doc_id", "text").dropDuplicates(["doc_id"])
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(several)
    found = links(texts, heads.select(F.col("head").alias("doc_id")).distinct(), word_idf(docs, text), least)
    # Rows that share an id are one document: its texts' heads link.
    same = own.where("sha is not null").join(repeated, "doc_id", "left_semi").join(heads, "sha").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    roots = components(found.unionByName(same))
    of_head = heads.join(roots.withColumnRenamed("id", "head"), "head", "left").select(F.col("sha").alias("s"), F.coalesce("root", "head").alias("class_id"))
    joined = own.join(of_head, own["sha"] == of_head["s"], "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """df without the documents whose class has a smaller id; columns as before."""
    name = fresh(df, "near_dedup_gone")
    gone = settle(classes(df, doc_id, text, least).where("class_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return df.join(gone, F.col(doc_id) == F.col(name), "left_anti")
