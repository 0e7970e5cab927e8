"""Helpers shared by the corpus operators: tables, settled results, word counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set: a temporary one in local mode (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            path = made.get()
        elif spark.sparkContext.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="spanwise-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


def settle(df: DataFrame, what: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, so a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._settled_at = path
    return made


def discard(*settled: DataFrame) -> None:
    """Delete tables of settle() once everything read from them is settled itself."""
    for df in settled:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Keys with more than one row in so many are hot: there are at most this many of them.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, whose keys are unique. counts says in its column n how many rows of left a
    key has, of `total` in all. Hot keys, at most HOT_KEYS, are joined by a broadcast, so that no task gets all rows of
    one; the others by a shuffle. All sides are read more than once: settle them first."""
    names = [c for c in right.columns if c not in on]
    right = right.withColumn("_in", F.lit(True))
    few = counts.where(F.col(n) * HOT_KEYS > total).select(*on).join(right, on, "left").withColumn("_hot", F.lit(True))
    tagged = left.join(F.broadcast(few.withColumnsRenamed({c: f"_hot_{c}" for c in [*names, "_in"]})), on, "left")
    met = tagged.where("_hot" if how == "left" else "_hot and _hot__in")
    rest = tagged.where("_hot is null").select(*left.columns).join(right.drop("_in"), on, how)
    return met.select(*left.columns, *(F.col(f"_hot_{c}").alias(c) for c in names)).unionByName(rest.select(*left.columns, *names))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: at most 8 MB or 1,000 rows, for executors with little memory.
    Python workers also get this package's folder, as when it was not installed but put on sys.path."""
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, here]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
