"""Stage tables: a pipeline's results by stage, as Parquet, to resume from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run(spark: SparkSession, first: DataFrame, stages: Sequence[Stage], folder: str, start: str | None = None) -> DataFrame:
    """The last stage's rows. Each stage's result is written to folder/<name> and read again by the next; with `start`, the
    stages before it are not run but read, which is an error where one of them was never written."""
    names = [name for name, _ in stages]
    at = 0 if start is None else names.index(start)
    now = first if at == 0 else spark.read.parquet(f"{folder}/{names[at - 1]}")
    for name, stage in stages[at:]:
        stage(now).write.mode("overwrite").parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    return now
