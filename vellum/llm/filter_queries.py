"""Queries of the URL filter and of language identification: trained models, so they are tested on fixtures and held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.ppm_language import identify
from vellum.llm.url_filter import classify

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
    return judged.selectExpr("id AS page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_url_filter": op2_url_filter, "op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
