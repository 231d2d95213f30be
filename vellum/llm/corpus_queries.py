"""Queries of line and near deduplication and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontamination import find_leaks
from vellum.llm.line_dedup import HAS_WORD, MIN_LINES, MIN_WORDS, delete_repeated_runs, has_words
from vellum.llm.near_dedup import near_duplicates


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = delete_repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("id AS doc_id", "class_row AS class_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.selectExpr("id AS doc_id", "size(leaks) > 0 AS contaminated", "leaks.item_id AS item_ids", "leaks.distance AS distances")


OP5_SQL = rf"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS said, unnest(range(len(string_split(text, chr(10))))) AS line
    FROM documents WHERE text IS NOT NULL),
worded AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq FROM lines WHERE regexp_matches(said, '{HAS_WORD}')),
runs AS (
    SELECT doc_id, seq, said, lead(said) OVER (PARTITION BY doc_id ORDER BY seq) AS after FROM worded),
later AS (
    SELECT doc_id, seq FROM (
        SELECT doc_id, seq, row_number() OVER (PARTITION BY said, after ORDER BY doc_id, seq) AS copy FROM runs WHERE after IS NOT NULL)
    WHERE copy > 1),
singles AS (
    SELECT doc_id, seq FROM (
        SELECT doc_id, seq, row_number() OVER (PARTITION BY said ORDER BY doc_id, seq) AS copy FROM worded
        WHERE regexp_matches(said, '{has_words(MIN_WORDS)}'))
    WHERE copy > 1),
gone AS (
    SELECT doc_id, seq + d AS seq FROM later, range({MIN_LINES}) AS t(d) UNION SELECT doc_id, seq FROM singles),
kept AS (
    SELECT l.doc_id, string_agg(l.said, chr(10) ORDER BY l.line) FILTER (g.seq IS NULL) AS text, count(*) AS n_lines, count(g.seq) AS n_removed
    FROM lines l LEFT JOIN worded w ON w.doc_id = l.doc_id AND w.line = l.line
    LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.seq = w.seq GROUP BY l.doc_id),
starts AS (
    SELECT a.doc_id, count(*) AS n_runs FROM gone a LEFT JOIN gone b ON a.doc_id = b.doc_id AND a.seq = b.seq + 1 WHERE b.seq IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN starts s ON s.doc_id = d.doc_id
"""

QUERIES = {"op5_line_dedup": op5_line_dedup, "op8_minhash_near_dedup": op8_minhash_near_dedup, "op9_decontamination": op9_decontamination}
ORACLES = {"op5_line_dedup": OP5_SQL}
