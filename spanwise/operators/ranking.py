"""Ranking, sampling, majority and quantiles by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int, name: str = "place") -> DataFrame:
    """The first `most` rows of each group, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def majority(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent value; of equally frequent ones the first seen."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("votes"))


def quantile_rows(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics by position min(n - 1, int(n * p)), without interpolation."""
    w = Window.partitionBy(*by)
    numbered = df.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(value)) - 1})
    pick = {k: F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)), F.col(value))).alias(k) for k, p in shares.items()}
    return numbered.groupBy(*by).agg(F.count("*").alias("n"), *pick.values())


def spread_sample(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows at positions 0, n/3, 2n/3 and n - 1 of each group."""
    w = Window.partitionBy(*by)
    numbered = df.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order)) - 1})
    places = [F.lit(0), F.floor(F.col("_n") / 3), F.floor(2 * F.col("_n") / 3), F.col("_n") - 1]
    return numbered.where(F.col("_i").isin(*places)).drop("_n").withColumnRenamed("_i", "place")


def runs(df: DataFrame, by: Sequence[str], value: Column, order: str) -> DataFrame:
    """df with the number and the size of the run of equal values each row is in."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    new = F.when(F.row_number().over(w) == 1, 1).when(before.eqNullSafe(value), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return marked.withColumn("run_rows", F.count("*").over(Window.partitionBy(*by, "run")))


def first_middle_last(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows at positions 0, n/2 and n - 1 of each group."""
    w = Window.partitionBy(*by)
    numbered = df.withColumns({"_n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(order)) - 1})
    return numbered.where(F.col("place").isin(F.lit(0), F.floor(F.col("_n") / 2), F.col("_n") - 1)).drop("_n")


def speaker(faces: DataFrame, by: Sequence[str], face: str, last: str | None = None) -> DataFrame:
    """Each frame's likely speaker: 0.3 of area, centre and motion each (0 to 1), and 0.1 for the last frame's speaker."""
    held = F.when(F.col(face) == F.col(last), 0.1).otherwise(0.0) if last else F.lit(0.0)
    score = 0.3 * F.col("area") + 0.3 * F.col("centre") + 0.3 * F.col("motion") + held
    best = faces.withColumn("_score", score).groupBy(*by).agg(F.max(F.struct(F.col("_score").alias("score"), (-F.col(face)).alias("f"))).alias("b"))
    return best.select(*by, (-F.col("b.f")).alias(face), F.col("b.score").alias("score"))


def preferred(files: DataFrame, by: Sequence[str], path: str, lang: str, wanted: str, fallback: str = "ko") -> DataFrame:
    """One file a group: in the wanted language, else a variant of it, else the fallback's, else a variant of that, else any."""
    tag = F.lower(F.coalesce(lang, F.lit("")))
    rank = F.lit(4)
    for i, name in ((3, f"{fallback}-"), (1, f"{wanted}-")):
        rank = F.when(tag.startswith(name), i).otherwise(rank)
    rank = F.when(tag == wanted, 0).when((tag == fallback) & (rank > 1), 2).otherwise(rank)
    return files.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), F.col(path).alias("p"))).alias("b")).select(*by, F.col("b.p").alias(path))


def accept(ranked: DataFrame, by: Sequence[str], rank: str, score: str, valid: Column, most: int, floor: float = 0.4) -> DataFrame:
    """ranked rows that are taken, with their place: going down the ranks, valid rows count until `most` are taken; a score under
    the floor is passed over once one is taken. So the best valid row is taken whatever its score, and an invalid one opens no
    floor: the rule needs the first valid rank only, no walk."""
    some = ranked.where(valid)
    first = F.min(rank).over(Window.partitionBy(*by))
    able = some.withColumn("_first", first).where((F.col(rank) == F.col("_first")) | (F.col(score) >= floor)).drop("_first")
    return able.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where(F.col("place") <= most)
