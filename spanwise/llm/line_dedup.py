"""Line dedup: runs of lines that occur earlier in the corpus are deleted, found by winnowing.

The lines of a document (blank ones apart; outer blanks do not count) are hashed. What can match are
windows that the text alone decides: every `run` consecutive lines; the fewest lines from any line on,
under `run`, that hold `words` words; and a document of under `run` lines as a whole. The smallest hash
in a window is its fingerprint, so two equal windows share one for sure, and few places of a document
are marked. Marks are counted by fingerprint; the windows of those that recur are joined, by 128 bits
over all their lines, with the corpus' first place of the same content, in order of document and line.
Matches on one diagonal (the same shift between the same two documents) that touch or overlap are one
longer match, extended both ways as far as the lines agree; a later match's lines go. So a line goes
if, and only if, it lies in a window that stands earlier too.

No fingerprint's positions are gathered or paired: counts and first places are aggregated on the map
side and joined back, the hot ones (at most 1,000 keys) by a broadcast and the rest by a shuffle.

Defined results: null texts stay null; blank lines stay; null ids are left alone; rows equal in id and
text are one document, and other rows that share an id are documents in the order of a hash of their
text; an empty table gives none. Columns of the input pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_hot, n_words, settle

RUN, WORDS = 3, 50
_BLANK = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(s: Column, run: int, words: int) -> Column:
    """The windows that start at line s of (hs: hashes, ws: words of the lines), with the place of their fingerprint."""
    size = F.size("hs")

    def window(length: int | Column, kind: int) -> Column:
        here = F.slice("hs", s + 1, length)
        return F.struct(
            s.alias("s"), F.lit(length).cast("int").alias("n") if isinstance(length, int) else length.alias("n"),
            (s + F.array_position(here, F.array_min(here)).cast("int") - 1).alias("p"),
            F.xxhash64(here, F.lit(kind)).alias("k1"), F.xxhash64(F.lit(run), here, F.lit(kind)).alias("k2"),
        )

    held = lambda n: F.aggregate(F.slice("ws", s + 1, n), F.lit(0).cast("long"), lambda a, x: a + x)
    few = F.lit(None)
    for n in range(run - 1, 0, -1):
        few = F.when((s + n <= size) & (held(n) >= words), window(n, 0)).otherwise(few)
    long = F.when(s + run <= size, window(run, 0))
    whole = F.when((s == 0) & (size < run), window(size, 1))
    return F.filter(F.array(few, long, whole), lambda w: w.isNotNull())


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, tx, from_line, to_line, first_id, first_tx, first_line): the maximal runs of non-blank lines (from 0, end
    exclusive) that stand earlier too, and where; tx is xxhash64 of the text."""
    bare = F.filter(F.transform(_lines(F.col(text)), _bare), lambda x: x != "")
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tx"), bare.alias("ls"))
    lines = lines.select("doc_id", "tx", F.transform("ls", lambda x: F.xxhash64(x)).alias("hs"), F.transform("ls", n_words).alias("ws"))
    lines = settle(lines.where(F.size("hs") > 0).dropDuplicates(["doc_id", "tx"]), "lines")

    every = lines.select("doc_id", "tx", "hs", F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda s: _windows(s, run, words)).alias("at"))
    places = F.array_distinct(F.flatten(F.transform("at", lambda ws: F.transform(ws, lambda w: w.p))))
    placed = every.select("*", F.explode(places).alias("p"))
    near = F.flatten(F.slice("at", F.greatest(F.col("p") - run + 1, F.lit(0)) + 1, run))
    own = F.transform(F.filter(near, lambda w: w.p == F.col("p")), lambda w: w.dropFields("p"))
    marks = settle(placed.select("doc_id", "tx", F.expr("hs[p]").alias("f"), own.alias("ws")), "marks")
    recur = settle(marks.groupBy("f").agg(F.count("*").alias("of_f")).where("of_f > 1"), "recur")
    runs = settle(join_hot(marks, recur.select("f"), ["f"], recur, "of_f", marks.count()).select("doc_id", "tx", F.inline("ws")), "runs")
    first = runs.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tx", "s")).alias("first"), F.count("*").alias("of_k")).where("of_k > 1")
    first = settle(first, "first")
    joined = join_hot(runs, first.drop("of_k"), ["k1", "k2"], first, "of_k", runs.count())
    later = joined.where(F.struct("doc_id", "tx", "s") > F.col("first")).select(
        "doc_id", "tx", "s", (F.col("s") + F.col("n")).alias("e"), F.col("first.doc_id").alias("first_id"), F.col("first.tx").alias("first_tx"), (F.col("first.s") - F.col("s")).alias("shift")
    )
    # One shuffle by document serves the islands on each diagonal, and what groups by document later on.
    diagonal = Window.partitionBy("doc_id", "tx", "first_id", "first_tx", "shift").orderBy("s", "e")
    reach = F.max("e").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    parted = later.repartition("doc_id", "tx").withColumn("new", F.when(F.coalesce(F.col("s") <= reach, F.lit(False)), 0).otherwise(1))
    parted = parted.withColumn("part", F.sum("new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parted.groupBy("doc_id", "tx", "first_id", "first_tx", "shift", "part").agg(F.min("s").alias("from_line"), F.max("e").alias("to_line"))
    return whole.select("doc_id", "tx", "from_line", "to_line", "first_id", "first_tx", (F.col("from_line") + F.col("shift")).alias("first_line"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> tuple[DataFrame, dict[str, str]]:
    """df with its text less the repeated runs, and the names of two new columns: n_lines (not blank), n_removed."""
    names = {c: fresh(df, c) for c in ("n_lines", "n_removed")}
    own_id, tx, runs, filled, gone, left, lines = (fresh(df, f"line_dedup_{c}") for c in ("id", "tx", "runs", "filled", "gone", "left", "lines"))
    found = matches(df, doc_id, text, run, words).groupBy("doc_id", "tx").agg(F.collect_list(F.struct("from_line", "to_line")).alias(runs)).withColumnsRenamed({"doc_id": own_id, "tx": tx})
    some = df.join(found, (F.col(doc_id) == F.col(own_id)) & (F.xxhash64(text) == F.col(tx)), "left")
    some = some.withColumn(filled, F.filter(F.transform(_lines(F.col(text)), lambda x, i: F.when(_bare(x) != "", i)), lambda i: i.isNotNull()))
    taken = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.slice(filled, r["from_line"] + 1, r["to_line"] - r["from_line"]))))
    some = some.withColumn(gone, F.when(F.col(runs).isNotNull(), taken))
    hit = F.col(gone).isNotNull()
    some = some.withColumn(left, F.when(hit, F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col(text))) - 1), gone))).withColumn(lines, F.when(hit, _lines(F.col(text))))
    kept = F.when(hit, F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")).otherwise(F.col(text))
    counts = [F.coalesce(F.size(filled), F.lit(0)), F.when(hit, F.size(gone)).otherwise(0)]
    new = [F.when(F.col(text).isNotNull(), c).otherwise(0).cast("long").alias(n) for c, n in zip(counts, names.values(), strict=True)]
    return some.select(*(kept.alias(c) if c == text else F.col(c) for c in df.columns), *new), names


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """df with its text less the repeated runs; documents that lose every line they had go."""
    out, names = dedup(df, doc_id, text, run, words)
    return out.where((F.col(names["n_removed"]) == 0) | (F.col(names["n_removed"]) < F.col(names["n_lines"]))).drop(*names.values())


def sql(run: int = RUN, words: int = WORDS) -> str:
    """The same by sorting all windows; for run = 3."""
    if run != 3:
        raise ValueError("the SQL is written for runs of three lines")
    blank = r"E' \t\x0b\x0c\r'"
    return f"""
with raw as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
kept as (
  select doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i], {blank}) <> '') as filled from raw),
bare as (
  select doc_id, list_transform(filled, lambda i: trim(ls[i], {blank})) as xs from kept),
counted as (
  select doc_id, xs, len(xs) as n, list_transform(xs, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) as ws from bare),
places as (
  select doc_id, xs, n, ws, unnest(range(1, n + 1)) as s from counted),
windows as (
  select doc_id, s, 0 as kind, xs[s:s + 2] as w from places where s + 2 <= n
  union all select doc_id, s, 0, xs[s:s] from places where ws[s] >= {words}
  union all select doc_id, s, 0, xs[s:s + 1] from places where s < n and ws[s] < {words} and ws[s] + ws[s + 1] >= {words}
  union all select doc_id, 1, 1, xs from counted where n in (1, 2)),
ranked as (
  select doc_id, s, len(w) as n, row_number() over (partition by kind, w order by doc_id, s) as place from windows),
gone as (
  select doc_id, list_distinct(flatten(list(range(s, s + n)))) as g from ranked where place > 1 group by doc_id),
outcome as (
  select k.doc_id, k.ls, k.filled, coalesce(list_transform(g.g, lambda j: k.filled[j]), []) as rm from kept k left join gone g using (doc_id))
select d.doc_id, coalesce(len(filled), 0)::bigint as n_lines, coalesce(len(rm), 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(rm, i)), lambda i: ls[i]), chr(10)), '')) as kept_sha256
from documents d left join outcome using (doc_id)"""
