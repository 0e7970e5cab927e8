"""Mixing sources to target weights: exact token budgets by distributed prefix sums.

A document's key is hash-random, so documents in key order are a random order of their source. Key
ranges split a source into buckets of about max(ROWS, sqrt(rows)) documents; bucket totals give each
bucket's start by a prefix sum over buckets, and a second prefix sum runs inside each bucket. The
document at which the running total passes a source's budget is its cut: one row for each source is
then enough to tell any document what the mix takes of it. No source is ever gathered in one task.

Budgets: sources weigh by their place in code point order (null last), cyclically; targets share
`share` times all words; none exceeds `repeat` times its source's words, and the excess is reshared by
weight (water-filling). A target of more than one source size repeats whole epochs first.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own; a
null id has a key too; equal keys are ordered by id, size and text, and rows equal in all of these share
evenly, rounded down, what the cut takes of them, if they are it; an empty table gives none. Columns
of the input pass through; new names avoid them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, fresh, n_words, settle

WEIGHTS, SHARE, REPEAT, ROWS = (3, 1, 2), 1.5, 2, 4096
_SPACE = 1 << 48


def _key(doc_id: Column) -> Column:
    """Hash-random, below 2**48."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, rows, source_size, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (F.lit(float(share)) * whole - before) / left)
    # The level of the first source that its cap does not hold back is the highest among such.
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return per.select("source", "rows", "source_size", target.alias("target"))


def cuts(slim: DataFrame, goals: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row a source: source_size, target, whole epochs, the cut document's order and the words taken of it.

    slim: (source, size, place), place a struct that starts with the key."""
    budget = F.floor("target").cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    goals = goals.withColumn("buckets", F.ceil(F.col("rows") / F.greatest(F.lit(float(rows)), F.sqrt("rows"))))
    joined = slim.withColumnRenamed("source", "of").join(goals, F.col("of").eqNullSafe(F.col("source")))
    dealt = joined.select("source", "size", "place", "rest", F.floor(F.col("place.key") / F.lit(float(_SPACE)) * F.col("buckets")).cast("long").alias("bucket"))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    start = F.sum("total").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "total", F.coalesce(start, F.lit(0)).alias("start"))
    # Only the bucket in which a source's budget ends is sorted.
    last = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).where("start <= rest and rest < start + total")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    run = last.withColumn("before", F.col("start") + F.coalesce(inside, F.lit(0)))
    # Rows equal in their place cannot be told apart: they share evenly what the cut takes of them.
    same = run.groupBy("source", "place", "rest", "size").agg(F.min("before").alias("before"), F.count("*").alias("n"))
    cut = same.where("before <= rest and rest < before + n * size").select(F.col("source").alias("s"), F.col("place").alias("cut"), F.expr("(rest - before) div n").alias("part"))
    return goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rows", "rest", "buckets")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> tuple[DataFrame, dict[str, str]]:
    """df with what the mix takes of each row, and the new columns' names: size, source_size, target, taken."""
    names = {c: fresh(df, f"mix_{c}") for c in ("size", "source_size", "target", "taken", "place", "source")}
    place = F.struct(_key(F.col(doc_id)).alias("key"), F.col(doc_id).alias("id"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("text"))
    slim = settle(df.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), place.alias("place")), "sizes")
    cut = settle(cuts(slim, targets(slim, **how)), "cuts")
    of = {c: fresh(df, f"mix_of_{c}") for c in ("source_size", "target", "epochs", "cut", "part")}
    cut = cut.select(F.col("source").alias(names["source"]), *(F.col(c).alias(n) for c, n in of.items()))
    full = df.withColumn(names["place"], place).withColumn(names["size"], F.col(names["place"]).getField("size"))
    full = full.join(cut, F.col(source).eqNullSafe(F.col(names["source"])), "left")
    size, at = F.col(names["size"]), F.col(names["place"])
    more = F.when(F.col(of["cut"]).isNull(), 0).when(at < F.col(of["cut"]), size).when(at == F.col(of["cut"]), F.col(of["part"])).otherwise(0)
    taken = F.col(of["epochs"]) * size + more
    new = [size, F.col(of["source_size"]).alias(names["source_size"]), F.col(of["target"]).alias(names["target"]), taken.cast("long").alias(names["taken"])]
    return full.select(*df.columns, *new), names


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row once for every epoch that takes it whole; of a cut document the first
    words, one blank apart. Columns as in df; rows of which nothing is taken are not in it."""
    out, names = mix(df, doc_id, text, source, **how)
    size, taken = F.col(names["size"]), F.col(names["taken"])
    copy = fresh(out, "mix_copy")
    out = out.where(taken > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    words = F.least(size, taken - (F.col(copy) - 1) * size)
    first = F.array_join(F.slice(F.filter(F.split(text, BLANKS), lambda w: w != ""), 1, words.cast("int")), " ")
    columns = [F.when(words < size, first).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in df.columns]
    return out.select(*columns)


def sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> str:
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as key
  from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [{", ".join(map(str, weights))}][1 + (row_number() over (order by source nulls last) - 1) % {len(weights)}] as weight, {repeat} * source_size as cap
  from per),
leveled as (
  select *, ({share}::double * (sum(source_size) over ())::double
             - coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
            / (sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following))::double as level
  from ranked),
goals as (
  select source, source_size,
         least(cap::double, weight::double * (max(case when level <= cap::double / weight then level end) over ())) as target
  from leveled),
runs as (
  select s.*, g.source_size, g.target,
         case when g.source_size > 0 then floor(g.target)::bigint // g.source_size else 0 end as epochs,
         coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
from runs"""
