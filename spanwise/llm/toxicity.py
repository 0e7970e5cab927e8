"""Toxicity: class-conditional Kneser-Ney models, compared by length-normalised log-likelihood.

A text is its words of letters, lowered, one blank behind each and ORDER - 1 before the first, as UTF-8
bytes; its n-grams are up to ORDER of these, so an n-gram's code is the bytes themselves. They are counted
in Spark by class over all labelled training documents. Orders above SHARED have a model for each class,
interpolated with the next lower order's continuation counts; the orders up to SHARED are continuation counts
of both classes together, so that expressions rare in both are smoothed alike and say little. The classes
differ in size, and distinct contexts do not grow in proportion to a corpus, so the ordinary class counts as
an average sample of the toxic class' size: o / S occurrences, of which 1 - (1 - 1/S)**o distinct, S being the
classes' ratio. Every document counts, and neither class looks richer for being larger.

Every n-gram that was counted is in the model, a Spark table, and scores. Documents meet it in two ways that
give the same sums. Up to GRAMS entries, those counted most often, are sent to executors (16 bytes each) and
looked up there. Where the table has more, the documents' other n-grams are exploded and joined with it; a
bitmap of fixed size keeps n-grams that the table does not hold out of that shuffle. With counts come all
shorter and preceding n-grams, so a lookup stops at the longest one it knows.

A document's log-likelihood ratio a character, the share of it from telling places, and its deviation from
chance enter a logistic calibration, fitted on held-back training rows (about CALIBRATE, by hash, half of
them of each class, weighted back to the classes' shares; all training rows where a class has none there).
Log ratios are whole millionths, so that sums do not depend on the order of rows.

Defined results: null, empty and wordless texts get the score of a document without evidence; ids are
never inputs; repeated rows score alike; a document labelled both 0 and 1 counts for both; without labelled
rows of both classes the score is the share of toxic ones (0 if there are none); rows without a label or id
are not learned from; very long texts are read whole, in slices; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, small_batches
from .textblock import NO_LETTER, Block, all_blocks

ORDER, SHARED, CALIBRATE, TELLING = 6, 3, 20_000, 2.0
#: Entries of the model that go to every executor, at most.
GRAMS = 1_000_000
#: Labelled tables of up to so many rows go to every executor; larger ones are joined by a shuffle.
FEW = 500_000
#: Bits of the bitmap of the joined n-grams (16 MB), and the unit of log ratios.
BITS, UNIT = 27, 1e6
#: Places of a text, or n-grams of a task, that are held at a time.
SLICE, HELD = 1 << 20, 1 << 21
_BLANK = 32


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], and 0 where at is -1."""
    return np.where(at >= 0, values[at], 0).astype(float) if len(values) else np.zeros(len(at))


def _low(n: int) -> np.uint64:
    """The bits of the last n bytes of a code."""
    return np.uint64((1 << 8 * n) - 1)


class Codes:
    """The n-grams of ORDER that end at each place of the texts, slice by slice."""

    def __init__(self, texts: pa.Array):
        b = Block(texts, NO_LETTER, fold=True)
        letters = b.ends - b.starts
        solid = np.flatnonzero(~b.blank)
        words = np.diff(b.word_at)
        ahead = np.cumsum(letters + 1) - letters - 1 + (ORDER - 1) * (b.word_doc() + 1)
        self.places = np.bincount(b.word_doc(), letters + 1, minlength=b.n).astype(np.int64) if len(words) else np.zeros(b.n, np.int64)
        self.ends = np.cumsum(self.places + ORDER - 1)
        self.symbols = np.full(int(self.ends[-1]) if b.n else 0, _BLANK, np.uint8)
        self.symbols[solid + np.repeat(ahead - b.starts, letters)] = b.bytes[solid]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, code) of the places, in order."""
        first = self.ends - self.places  # of each document
        for at in range(0, max(0, len(self.symbols) - ORDER + 1), SLICE):
            x = self.symbols[at : at + SLICE + ORDER - 1].astype(np.uint64)
            two = x[:-1] << np.uint64(8) | x[1:]
            four = two[:-2] << np.uint64(16) | two[2:]
            code = four[:-2] << np.uint64(16) | two[4:]
            place = np.arange(at + ORDER - 1, at + ORDER - 1 + len(code))
            doc = self._docs(place)
            inside = place >= first[doc]
            yield doc[inside], code[inside]

    def _docs(self, place: np.ndarray) -> np.ndarray:
        """Document of each of the consecutive places."""
        cuts = np.searchsorted(place, self.ends)
        return np.repeat(np.arange(len(self.ends)), np.diff(np.concatenate([[0], cuts])))


class Lookup:
    """Places of keys (not 0) in an array, by open addressing over a table of at most half load."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.at[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        todo = np.flatnonzero((held != keys) & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
        return out


@dataclass
class Model:
    """codes: of the n-grams that are looked up; value: their log ratio; context: log ratio of the weights that they,
    as contexts, leave to the next lower order. Ratios are in UNITs. rest: (code, value, telling, context) of all other
    n-grams, value and telling being what the n-gram adds to its backoff; bitmap: where their codes fall."""

    codes: np.ndarray
    value: np.ndarray
    context: np.ndarray
    weights: np.ndarray | None = None
    bitmap: np.ndarray | None = None
    rest: DataFrame | None = None
    _find: Lookup | None = field(default=None, repr=False)

    def local(self) -> Model:
        """What executors need."""
        return replace(self, rest=None, _find=None)

    def find(self, codes: np.ndarray) -> np.ndarray:
        if self._find is None:
            self._find = Lookup(self.codes)
        return self._find(codes)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Of each text: places, and the looked up n-grams' log ratios and telling excess."""
        every = Codes(texts)
        out = np.zeros((len(texts), 3))
        out[:, 0] = every.places
        for doc, code in every:
            at = self.find(code)
            value = _taken(self.value, at)
            telling = np.maximum(value - TELLING * UNIT, 0)
            todo = np.flatnonzero(at < 0)
            for n in range(ORDER, SHARED, -1):  # the n-gram is not known: its context's weight, and the next shorter one
                own = code[todo]
                leaves = self.find((own & _low(n)) >> np.uint64(8))
                value[todo] += _taken(self.context, leaves)
                if n - 1 > SHARED:
                    shorter = self.find(own & _low(n - 1))
                    ratio = _taken(self.value, shorter)
                    value[todo] += ratio
                    telling[todo] = np.maximum(ratio - TELLING * UNIT, 0)
                    todo = todo[shorter < 0]
            for column, x in ((1, value), (2, telling)):
                out[:, column] += np.bincount(doc, x, minlength=len(texts))
        return out

    def others(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(document, code, times, times as a context) of the n-grams that may be in rest."""
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for doc, code in Codes(texts):
            todo = np.flatnonzero(self.find(code) < 0)
            for n in range(ORDER, SHARED, -1):
                own = code[todo] & _low(n)
                found += [(doc[todo], own, 0), (doc[todo], own >> np.uint64(8), 1)]
                todo = todo[self.find(own & _low(n - 1)) < 0]
        docs, codes, leads = [], [], []
        for doc, code, lead in found:
            take = np.flatnonzero(_in_bitmap(code, self.bitmap))
            if lead:
                take = take[self.find(code[take]) < 0]
            docs.append(doc[take])
            codes.append(code[take])
            leads.append(np.full(len(take), lead))
        if not docs:
            return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        doc, code, lead = map(np.concatenate, (docs, codes, leads))
        order = np.lexsort((code, doc))
        doc, code, lead = doc[order], code[order], lead[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(doc) else np.zeros(0, np.int64)
        led = np.add.reduceat(lead, first) if len(first) else lead
        return doc[first], code[first], np.diff(np.append(first, len(doc))) - led, led

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores by the looked up n-grams alone."""
        return _logistic(_features(self.sums(texts)) @ self.weights)


def _features(sums: np.ndarray) -> np.ndarray:
    """Mean log ratio a character, its deviation, the mean of telling places' excess, its deviation, 1."""
    n = np.maximum(sums[:, 0], 1)
    total, telling = sums[:, 1] / UNIT, sums[:, 2] / UNIT
    return np.stack([total / n, total / np.sqrt(n), telling / n, telling / np.sqrt(n), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


#: Spreads codes over the bitmap; a fixed odd number below 2**31, so that the product of it and 32 bits fits in a long.
_SPREAD = 0x5851F42D


def _slots(codes: np.ndarray) -> np.ndarray:
    folded = (codes ^ codes >> np.uint64(24)) & np.uint64((1 << 32) - 1)
    return folded * np.uint64(_SPREAD) >> np.uint64(30) & np.uint64((1 << BITS) - 1)


def _slots_sql(code: str) -> Column:
    folded = F.expr(f"({code} ^ shiftrightunsigned({code}, 24)) & {(1 << 32) - 1}L")
    return F.shiftrightunsigned(folded * F.lit(_SPREAD).cast("long"), 30).bitwiseAND((1 << BITS) - 1)


def _in_bitmap(codes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = _slots(codes)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(rest: DataFrame) -> np.ndarray:
    slots = rest.select(_slots_sql("code").alias("slot"))
    bits = slots.groupBy(F.shiftrightunsigned("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    got = bits.toArrow()  # at most 2**BITS / 32 rows
    found = np.zeros(1 << (BITS - 5), "<u4")
    found[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype("<u4")
    return found.view(np.uint8)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, text, toxic) of the documents that have a label and are not held out."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)").where(fold_of(F.col("_id")) != 0)
    known = settle(known.distinct(), "labels")
    if known.count() <= FEW:
        known = F.broadcast(known)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def counted(train: DataFrame) -> DataFrame:
    """(code, t, o): how often each n-gram of ORDER occurs in toxic and in ordinary texts. A task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, of = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(of, np.concatenate(times)).astype(np.int64)

        def rows(found: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            code, first = np.unique(found >> np.uint64(1), return_index=True)
            sums = [np.add.reduceat(np.where(found & np.uint64(1) == side, times, 0), first) for side in (1, 0)]
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *map(pa.array, sums)], names=["code", "t", "o"])

        for part in all_blocks(batches):
            toxic = np.asarray(part.column("toxic")).astype(np.uint64)
            for doc, code in Codes(part.column("text")):
                some, n = np.unique(code << np.uint64(1) | toxic[doc], return_counts=True)
                keys, times, held = [*keys, some], [*times, n], held + len(some)
                if held > HELD:
                    some, n = merged()
                    keys, times, held = [some], [n], len(some)
                    if held > HELD // 2:
                        yield rows(some, n)
                        keys, times, held = [], [], 0
        if held:
            yield rows(*merged())

    return train.mapInArrow(run, "code long, t long, o long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _discount(grams: DataFrame, k: str) -> float:
    one, two = grams.agg(F.count(F.when(F.col(k) == 1, 1)), F.count(F.when(F.col(k) == 2, 1))).first()
    return one / (one + 2 * two) if one and two else 0.75


def _left(discount: float, distinct: Column, total: Column) -> Column:
    """The weight that a context leaves to the next lower order."""
    share = F.least(F.greatest(discount * distinct / F.greatest(total, F.lit(1e-9)), F.lit(1e-6)), F.lit(1.0))
    return F.when(total > 0, share).otherwise(1.0)


def grams(train: DataFrame) -> DataFrame | None:
    """The model of (.., text, toxic): (code, n, times, value, context, more, telling) of every n-gram of SHARED to ORDER,
    settled, or None unless both classes have words. more and telling are what the n-gram adds to its backoff's ratio
    and telling excess; times, its occurrences, are no fewer for its parts."""
    top = settle(counted(train), "grams")
    toxic, ordinary = top.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    if not toxic or not ordinary:
        return None
    ratio = max(1.0, ordinary / toxic)
    sampled = lambda o: 1 - F.pow(F.lit(1 - 1 / ratio), F.col(o))
    orders = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(int(_low(n)))
        some = [F.sum(F.when(F.col("t") > 0, 1.0).otherwise(0.0)).alias("n_t"), F.sum(sampled("o")).alias("n_o"), F.count("*").cast("double").alias("n_any")]
        orders[n] = settle(orders[n + 1].groupBy(suffix.alias("code")).agg(F.sum("t").alias("t"), F.sum("o").alias("o"), *some), "grams")

    # Shared orders: continuation counts of both classes.
    whole, size = orders[1].agg(F.sum("n_any"), F.count("*")).first()
    below = orders[1].select("code", ((F.col("n_any") + 0.5) / F.lit(whole + 0.5 * size)).alias("p"))
    for n in range(2, SHARED + 1):
        discount = _discount(orders[n], "n_any")
        own = orders[n].select("code", "n_any", F.shiftright("code", 8).alias("lead"), F.col("code").bitwiseAND(int(_low(n - 1))).alias("suffix"))
        leads = own.groupBy("lead").agg(F.sum("n_any").alias("s"), F.count("*").alias("c"))
        met = own.join(leads, "lead").join(below.withColumnRenamed("code", "suffix"), "suffix")
        p = F.greatest(F.col("n_any") - discount, F.lit(0.0)) / F.col("s") + _left(discount, F.col("c"), F.col("s")) * F.col("p")
        below = settle(met.select("code", p.alias("p")), "shared")

    millionths = lambda x: F.round(F.log(x) * UNIT).cast("long")
    excess = lambda x: F.greatest(F.col(x) - int(TELLING * UNIT), F.lit(0))
    times = (F.col("t") + F.col("o")).alias("times")
    below = below.select("code", F.col("p").alias("q_t"), F.col("p").alias("q_o"), F.lit(0).cast("long").alias("under"))
    entries = orders[SHARED].select("code", times, F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("more"), F.lit(0).cast("long").alias("telling"))
    contexts, done = None, [(entries, SHARED)]
    for n in range(SHARED + 1, ORDER + 1):
        if n == ORDER:
            counts = [F.col("t").cast("double"), F.col("o") / F.lit(ratio), F.when(F.col("t") > 0, 1.0).otherwise(0.0), sampled("o")]
        else:
            counts = [F.col("n_t"), F.col("n_o"), F.when(F.col("n_t") > 0, 1.0).otherwise(0.0), F.least("n_o", F.lit(1.0))]
        own = orders[n].select("code", times, *(c.alias(a) for c, a in zip(counts, ("k_t", "k_o", "d_t", "d_o"), strict=True)))
        discount = _discount(own, "k_t")
        own = own.withColumns({"lead": F.shiftright("code", 8), "suffix": F.col("code").bitwiseAND(int(_low(n - 1)))})
        leads = own.groupBy("lead").agg(*(F.sum(c).alias(f"s_{c}") for c in ("k_t", "k_o", "d_t", "d_o")), F.sum("times").alias("led"))
        left = {c: _left(discount, F.col(f"s_d_{c}"), F.col(f"s_k_{c}")) for c in "to"}
        leads = settle(leads.select("lead", "s_k_t", "s_k_o", left["t"].alias("l_t"), left["o"].alias("l_o"), "led").withColumn("context", millionths(F.col("l_t") / F.col("l_o"))), "leads")
        met = own.join(leads, "lead").join(below.withColumnRenamed("code", "suffix"), "suffix")
        p = {c: F.greatest(F.col(f"k_{c}") - discount * F.col(f"d_{c}"), F.lit(0.0)) / F.greatest(f"s_k_{c}", F.lit(1e-9)) + F.col(f"l_{c}") * F.col(f"q_{c}") for c in "to"}
        made = met.select("code", "times", p["t"].alias("q_t"), p["o"].alias("q_o"), "under", "context").withColumn("value", millionths(F.col("q_t") / F.col("q_o")))
        made = settle(made, "order")
        # A context that is no n-gram itself (the blanks before a text) has an entry for its weight alone.
        held, under = done[-1]
        leads = leads.select(F.col("lead").alias("code"), "led", "context")
        whole = held.join(leads, "code", "full").select("code", F.coalesce("times", "led").alias("times"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("value", "context", "more", "telling")))
        contexts = whole.withColumn("n", F.lit(under)) if contexts is None else contexts.unionByName(whole.withColumn("n", F.lit(under)))
        done.append((made.select("code", "times", "value", (F.col("value") - F.col("under") - F.col("context")).alias("more"), (excess("value") - excess("under")).alias("telling")), n))
        below = made.select("code", "q_t", "q_o", F.col("value").alias("under"))
    every = contexts.unionByName(done[-1][0].withColumns({"context": F.lit(0).cast("long"), "n": F.lit(ORDER)}))
    every = settle(every, "model")
    discard(*orders.values())
    return every


def learn(train: DataFrame, most: int | None = None) -> Model | None:
    """The model of (.., text, toxic), or None unless both classes have words. most: GRAMS."""
    most = GRAMS if most is None else most
    every = grams(train)
    if every is None:
        return None
    # The least count, a power of two, of which no more than `most` entries are; 0 if that is all.
    least = 0
    if every.count() > most:
        sizes = dict(every.groupBy((F.length(F.bin("times")) - 1).alias("k")).agg(F.count("*")).collect())  # at most 64 rows
        held = 0
        for k in sorted(sizes, reverse=True):
            held += sizes[k]
            if held > most:
                least = 1 << (k + 1)
                break
    got = every.where(F.col("times") >= least).select("code", "value", "context").toArrow()  # at most `most` rows
    columns = [got.column(c).to_numpy() for c in ("code", "value", "context")]
    model = Model(columns[0].astype(np.int64).view(np.uint64), *(c.astype(np.int32) for c in columns[1:]))
    if least:
        model.rest = every.where(F.col("times") < least).select("code", F.col("more").alias("value"), "telling", "context")
        model.bitmap = _bitmap(model.rest)
    return model


def summed(rows: DataFrame, model: Model) -> DataFrame:
    """rows of (.., text) with their text replaced by sums: array of places, log ratios and telling excess."""
    kept = [c for c in rows.columns if c != "text"]
    key = F.xxhash64(*kept, "text") if model.rest is not None else F.lit(0).cast("long")
    rows = rows.select(key.alias("key"), F.struct(*kept).alias("row"), "text")
    table = rows.sparkSession.sparkContext.broadcast(model.local())

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            sums = table.value.sums(part.column("text")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), *(pa.array(c) for c in sums.T)], names=["key", "row", "n", "a", "b"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches):
            of, code, times, leads = table.value.others(part.column("text"))
            key = np.asarray(part.column("key"))[of]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(code.view(np.int64)), pa.array(times.astype(np.int32)), pa.array(leads.astype(np.int32))], names=["key", "code", "times", "leads"])

    kind = rows.schema["row"].dataType.simpleString()
    near = rows.mapInArrow(frequent, f"key long, row {kind}, n long, a long, b long")
    if model.rest is None:
        return near.select("row.*", F.array("n", "a", "b").alias("sums"))
    met = rows.select("key", "text").mapInArrow(others, "key long, code long, times int, leads int").join(model.rest, "code")
    a, b = F.col("times") * F.col("value") + F.col("leads") * F.col("context"), F.col("times") * F.col("telling")
    far = met.groupBy("key").agg(F.sum(a).alias("far_a"), F.sum(b).alias("far_b"))
    # Equal rows share a key, and their sums: each gets its part.
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    far = far.join(copies, "key").select("key", *((F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("far_a", "far_b")))
    joined = near.join(far, "key", "left").na.fill(0, ["far_a", "far_b"])
    return joined.select("row.*", F.array("n", F.col("a") + F.col("far_a"), F.col("b") + F.col("far_b")).alias("sums"))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, drawn: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method on scaled features. The rarer class weighs more, by the
    root of the classes' ratio: a score of 0.5 then stands between even odds and equal error rates."""
    drawn = np.ones(len(y)) if drawn is None else drawn  # how many rows each one stands for
    rare = (y * drawn).sum() / drawn.sum()
    weight = np.where(y == 1, ((1 - rare) / rare) ** 0.5, 1.0) * drawn
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model | None, float]:
    """The calibrated model, and the share of toxic documents for when there is none."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, doc_id, text, label)
    fold = fold_of(F.col("doc_id"))
    model = learn(rows.where(fold != 4))
    seen, ones, ones_back, seen_back = rows.agg(
        F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.when((fold == 4) & (F.col("toxic") == 1), 1)), F.count(F.when(fold == 4, 1))
    ).first()
    share = ones / seen if seen else 0.0
    if model is None:
        return None, share
    # Calibration rows come from a fold that the counts have not seen, where it has rows of both classes.
    apart = 0 < ones_back < seen_back
    back = rows.where(fold == 4) if apart else rows
    of_class = (seen_back - ones_back, ones_back) if apart else (seen - ones, ones)
    parts = [min(1.0, CALIBRATE / 2 / n) for n in of_class]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, parts[1]).otherwise(parts[0]) * (1 << 30)
    got = sorted((r.toxic, *r.sums) for r in summed(back.where(draw).select("doc_id", "toxic", "text"), model).collect())  # about CALIBRATE rows
    y, sums = np.array([r[0] for r in got], float), np.array([r[1:] for r in got], float).reshape(len(got), 3)
    if len(set(y)) < 2:
        return None, share
    model.weights = calibrate(_features(sums), y, drawn=np.where(y == 1, 1 / parts[1], 1 / parts[0]))
    return model, share


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model, share = train(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        out = rows.select("doc_id", F.lit(float(share)).alias("score"))
    else:
        weights = model.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                sums = part.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_logistic(_features(sums) @ weights))], names=["doc_id", "score"])

        out = summed(rows, model).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
