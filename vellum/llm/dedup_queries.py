"""Queries of the two exact deduplications. SQL would need every window as a row, so they are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.substring_dedup import remove_repeated_windows
from vellum.llm.suffix_dedup import remove_later_copies


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.selectExpr("id AS doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_later_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.selectExpr("id AS doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
