"""From raw documents to packed training sequences: five stages over the whole table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet
to the shared folder and gives it to the next. All but the last return the columns of documents; n_chars
follows the text where a stage changes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import line_dedup, near_dedup, quality_rules, sequence_packing, source_mixing
from spanwise.llm.common import settle, table


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model of the quality rules takes for good."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that occur earlier; documents that were nothing else go."""
    return _recount(line_dedup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate class."""
    return near_dedup.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents of repeated epochs come as often as they are taken."""
    return _recount(source_mixing.mixed(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences. Workers keep fewer words than when packing is all they do."""
    return sequence_packing.pack(docs, known=200_000)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("source mixing", mixing),
    ("packing", packing),
]

#: Label models, consistent sampling and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
