"""SimHash near-dedup by vantage-point trees.

A text's fingerprint has the bits that over half of its shingles' XXH64 values have; fingerprints link
at up to REACH differing bits, and linked ones are a component. Equal fingerprints are one node.

Of at most three differing bits, one of the two 32-bit halves has at most one. So each half has a
vantage-point tree of its own over the Hamming distance of that half, searched within a radius of one
(REACH // 2), in which distances tell more: on 64 bits, half of all random fingerprints lie within three
of the median distance and no branch could be pruned for them. The upper part of a tree is grown from a
bounded sample of the nodes (SAMPLE, of the smallest hashes) and sent to all tasks; its leaves are shards.
Every fingerprint has one home shard, and visits those shards before it that the triangle inequality
does not rule out: of a pair, the later home's member visits the earlier. Within a shard, a tree over
the members is grown to its leaves and asked for the members and visitors, again by triangle bounds; the
leaves compare whole fingerprints exactly. A shard returns links that join what is joined in it, at most
one a fingerprint, and shards with over PART rows are asked in parts. Components follow by star contraction.

Defined results: null and wordless texts have the fingerprint zero, which links like any other; texts of
fewer words than a shingle have one, all their words; rows with a null id get a fingerprint and a null
component and link nothing; rows that share an id are one document; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, small_batches
from .near_dedup import components
from .spans import Gapless, slices, xxh64
from .textblock import Block, all_blocks

SHINGLE, REACH = 3, 3
#: Nodes that the upper trees are grown from; fewest of them in a leaf; members aimed at in a shard; rows
#: of a shard that are asked together; members of a leaf inside a shard.
SAMPLE, LEAST, SHARD, PART, LEAF = 1 << 15, 8, 256, 200_000, 128


def fingerprints(block: Block, k: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each document, as uint64."""
    words = Gapless(block)
    first, doc = words.grams(k)
    end = first + k - 1
    count = np.diff(words.word_at)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first, end, doc = np.concatenate([first, words.word_at[short]]), np.concatenate([end, words.word_at[short + 1] - 1]), np.concatenate([doc, short])
    ones, total = np.zeros((block.n, 64), np.int64), np.bincount(doc, minlength=block.n)
    for part in slices(len(first)):
        found = xxh64(words.bytes, words.starts[first[part]], words.ends[end[part]])
        bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        of = doc[part]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ones[of[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def split(values: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """Vantage point, radius, and which values lie within it, or None where no cut divides the values. Of a
    few of the values, spread over them, the one whose distances vary most; the radius leaves about half inside."""
    best = None
    for point in values[:: max(1, len(values) // 8)][:8]:
        far = np.bitwise_count(values ^ point)
        sums = np.cumsum(np.bincount(far, minlength=65))
        radius = int(np.abs(2 * sums - len(values)).argmin())
        if 0 < sums[radius] < len(values) and (best is None or far.var() > best[0]):
            best = far.var(), int(point), radius, far <= radius
    return best and best[1:]


def grow(values: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, node inside, node outside) of a tree whose leaves hold about `least`
    values at least; a leaf has -1 as radius and its number as vantage point."""
    nodes: list[tuple[int, int, int, int]] = [(0, -1, 0, 0)]
    open_, leaves = [(0, values)], 0
    while open_:
        at, own = open_.pop()
        cut = split(own) if len(own) >= 2 * least else None
        if cut is None:
            nodes[at] = (leaves, -1, 0, 0)
            leaves += 1
        else:
            point, radius, inside = cut
            nodes[at] = (point, radius, len(nodes), len(nodes) + 1)
            nodes += [(0, -1, 0, 0)] * 2
            open_ += [(nodes[at][2], own[inside]), (nodes[at][3], own[~inside])]
    return nodes


def route(nodes: list[tuple[int, int, int, int]], values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of a value, leaf) for all leaves in which values within reach may lie."""
    found, open_ = [], [(0, np.arange(len(values)))]
    while open_:
        at, own = open_.pop()
        point, radius, inside, outside = nodes[at]
        if not len(own):
            continue
        if radius < 0:
            found.append((own, np.full(len(own), point)))
            continue
        far = np.bitwise_count(values[own] ^ values.dtype.type(point)).astype(np.int64)
        open_ += [(inside, own[far - reach <= radius]), (outside, own[far + reach > radius])]
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def half(values: np.ndarray, tree: int) -> np.ndarray:
    return (values >> np.uint64(32 * tree)).astype(np.uint32)


def linked(values: np.ndarray, member: np.ndarray, asks: np.ndarray, tree: int, reach: int = REACH) -> list[tuple[int, int]]:
    """Numbers of pairs of distinct values that join whatever members and asking values join within reach, where the
    tree's half differs in reach // 2 bits at most. A pair whose ends are joined already is left out."""
    part = half(values, tree)
    label, out = np.arange(len(values)), []
    open_ = [(np.flatnonzero(member), np.flatnonzero(asks))]
    while open_:
        own, asking = open_.pop()
        if not len(own) or not len(asking):
            continue
        cut = split(part[own]) if len(own) > LEAF else None
        if cut is None:
            for some in slices(len(asking), max(1, (1 << 20) // len(own))):
                x, y = np.nonzero(np.bitwise_count(values[asking[some], None] ^ values[own]) <= reach)
                x, y = asking[some][x], own[y]
                new = label[x] != label[y]
                for a, b in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    if label[a] != label[b]:
                        out.append((a, b))
                        label[label == label[b]] = label[a]
            continue
        point, radius, inside = cut
        far = np.bitwise_count(part[asking] ^ np.uint32(point)).astype(np.int64)
        open_ += [(own[inside], asking[far - reach // 2 <= radius]), (own[~inside], asking[far + reach // 2 > radius])]
    return out


def links(nodes: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): links between the distinct fingerprints of nodes (fp long) that join all that differ in up to reach bits."""
    total = nodes.count()
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if total < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    least = max(LEAST, SHARD * len(sample) // total)
    trees = [grow(half(sample, tree), least) for tree in (0, 1)]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("fp")).view(np.uint64)
            for tree in (0, 1):
                own = half(values, tree)
                at, leaf = route(trees[tree], own, 0)
                home = np.empty(len(values), np.int64)
                home[at] = leaf
                at, leaf = route(trees[tree], own, reach // 2)
                use = leaf <= home[at]
                at, leaf = at[use], leaf[use]
                arrays = [batch.column("fp").take(pa.array(at)), pa.array(np.full(len(at), tree, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(leaf == home[at])]
                yield pa.RecordBatch.from_arrays(arrays, names=["fp", "tree", "shard", "home"])

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        values = np.asarray(group.column("fp"))
        pairs = linked(values.view(np.uint64), np.asarray(group.column("home")), np.asarray(group.column("asks")), group.column("tree")[0].as_py(), reach)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": values[at[:, 0]], "b": values[at[:, 1]]})

    routed = settle(nodes.mapInArrow(sent, "fp long, tree int, shard int, home boolean"), "routed")
    # As many rows as the trees have leaves: SAMPLE / LEAST each at most.
    parts = routed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    dealt = F.pmod(F.xxhash64("fp"), F.col("parts"))
    meet = routed.join(F.broadcast(parts), ["tree", "shard"]).withColumn("own", dealt)
    meet = meet.withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("own"))))
    meet = meet.select("tree", "shard", "part", "fp", "home", (F.col("part") == F.col("own")).alias("asks"))
    return meet.groupBy("tree", "shard", "part").applyInArrow(compared, "a long, b long")


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp is the fingerprint as a long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            found = fingerprints(Block(part.column("text")), k)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = settle(own.mapInArrow(run, "doc_id long, fp long"), "fingerprints")
    heads = settle(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    # Rows that share an id are one document, so their fingerprints are joined.
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    same = several.join(own, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    roots = components(settle(links(heads.select("fp"), reach), "links").unionByName(same)).withColumnRenamed("id", "fp")
    known = heads.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = settle(known, "known")
    least = known.groupBy("root").agg(F.min("head").alias("component_id"))
    of = settle(known.join(least, "root").select(F.col("fp").alias("of_fp"), "component_id"), "components")
    joined = own.join(of, own["fp"] == of["of_fp"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose component has a smaller id; columns as before."""
    name = fresh(docs, "simhash_gone")
    gone = settle(marked(docs, doc_id, text).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")
