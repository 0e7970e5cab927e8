"""Queries of the corpus operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    importance_resampling, line_dedup, media_webp, near_dedup, periodic_runs, pii, quality_rules, sequence_packing, simhash_trees, source_mixing,
    substring_dedup, toxicity, url_filters,
)
from .common import settle, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = quality_rules.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = settle(docs.drop("text"), "quality")
    model = quality_rules.learn(docs, name)
    failed, posterior, kept = quality_rules.judged(docs, name, model)
    base = [F.col(f"{name}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return docs.select("doc_id", *base, failed.alias("base_failed"), kept.alias("kept"), posterior.alias("posterior"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").cast("long").alias("n_intervals"))


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_webp.digests(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = source_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *(F.col(n).alias(c) for c, n in names.items() if c in ("size", "source_size", "target", "taken")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.col("spans").getField(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("all")).alias("spans"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *(F.col(n).alias(c) for c, n in names.items()))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(n).alias(c) for c, n in names.items()), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_trees.marked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = periodic_runs.found(periodic_runs.planted(table(spark, sf_dir, "documents")))
    out = out.select("doc_id", F.col(name).alias("r"), periodic_runs.longest(F.col(name)).alias("top"))
    milli = F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long")
    return out.select(
        "doc_id", F.size("r.starts").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"),
        "r.runs_sha256", F.sha2(F.col("r.collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media_webp": op3_media_webp,
    "op4_source_mixing": op4_source_mixing,
    "op5_pii": op5_pii,
    "op6_url_filters": op6_url_filters,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_simhash_trees": op11_simhash_trees,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.sql(),
    "op4_source_mixing": source_mixing.sql(),
    "op9_line_dedup": line_dedup.sql(),
    "op13_importance_resampling": importance_resampling.sql(),
}
