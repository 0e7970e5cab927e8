"""Connected components of relationship edges, and ids in order of their first moment."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """nodes with `root`, the smallest key of the component: labels spread over edges, and every round also
    jump to their label's label, so long chains take few rounds. Lineage is cut by checkpoint()."""
    spark = nodes.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    linked = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct().checkpoint()
    # Only nodes with edges take part. Each has an edge to itself, which brings its own label to where its neighbours' meet.
    labels = nodes.select(F.col(key).alias("u")).distinct().join(linked.select("u"), "u", "left_semi").select("u", F.col("u").alias("label")).checkpoint()
    both = linked.unionByName(labels.select("u", F.col("u").alias("v")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("new"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old")).where("old is not null")
        jump = near.select(F.col("u").alias("new"), F.col("new").alias("far"))
        now = near.join(jump, "new", "left").select("u", F.least("new", F.coalesce("far", "new")).alias("label"), "old").checkpoint()
        labels = now.select("u", "label")
        if now.where("label <> old").isEmpty():
            found = labels.select(F.col("u").alias(key), F.col("label").alias("_label"))
            return nodes.where(F.col(key).isNotNull()).join(found, key, "left").withColumn("root", F.coalesce("_label", key)).drop("_label")


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one in local mode, where none is set."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spanwise-")


def numbered(df: DataFrame, by: list[str], root: str, at: str) -> DataFrame:
    """df with `sequence_id`, from 0: components of a source by their first moment, ties by root."""
    first = F.min(at).over(Window.partitionBy(*by, root))
    return df.withColumn("_first", first).withColumn("sequence_id", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first", root)) - 1).drop("_first")


def continuity(candidates: DataFrame, by: list[str], key: str, edges: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of keys that continue each other. candidates: by, chunk_index, candidate_index (of equal ones the last key counts), key
    and from_chunk and from_candidate, the row that one says it continues, or null.

    Without edges a row continues that candidate of its own chunk, or, if its chunk has none, the one of the chunk it names. With edges (by,
    type, from_chunk, from_candidate, to_chunk, to_candidate) a row's word counts within its chunk only, and `continuous` edges link the rest."""
    place = [*by, "_chunk", "_candidate"]
    known = candidates.groupBy(*by, F.col("chunk_index").alias("_chunk"), F.col("candidate_index").alias("_candidate")).agg(F.max(key).alias("_key"))
    told = candidates.where("from_candidate is not null").select(*by, F.col(key).alias("a"), "chunk_index", F.coalesce("from_chunk", F.lit(0)).alias("from_chunk"), F.col("from_candidate").alias("_candidate"))
    if edges is not None:
        told = told.where("from_chunk = chunk_index")
    own = told.withColumnRenamed("chunk_index", "_chunk").join(known, place, "left")
    links = own.where("_key is not null").select("a", F.col("_key").alias("b"))
    if edges is None:
        far = own.where("_key is null").drop("_key", "_chunk").withColumnRenamed("from_chunk", "_chunk").join(known, place)
        return links.unionByName(far.select("a", F.col("_key").alias("b"))).where("a <> b")
    ends = edges.where("type = 'continuous'").select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("from_chunk", "from_candidate", "to_chunk", "to_candidate")))
    starts = known.withColumnsRenamed({"_chunk": "from_chunk", "_candidate": "from_candidate", "_key": "a"})
    stops = known.withColumnsRenamed({"_chunk": "to_chunk", "_candidate": "to_candidate", "_key": "b"})
    joined = ends.join(starts, [*by, "from_chunk", "from_candidate"]).join(stops, [*by, "to_chunk", "to_candidate"])
    return links.unionByName(joined.select("a", "b")).where("a <> b")


def sequences(candidates: DataFrame, by: list[str], key: str, at: str, edges: DataFrame | None = None) -> DataFrame:
    """candidates with `sequence_id`: rows that continue each other, directly or not, share it; numbered from 0 by first moment, then key."""
    found = components(candidates, continuity(candidates, by, key, edges), key)
    return numbered(found, by, "root", at).drop("root")
