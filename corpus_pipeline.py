"""The corpus pipeline: documents in, clean tokenised documents out, stage by stage.

Each stage takes what its predecessor kept and returns the columns of documents;
the last returns the encoded documents. SQL cannot express the signatures, the edit
distances or the encoding, so there is no SQL for the whole; it is tested stage by
stage against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.byte_bpe import encode_and_decode
from vellum.llm.bpe_queries import RANKS
from vellum.llm.decontamination import drop_leaky
from vellum.llm.line_dedup import delete_repeated_runs
from vellum.llm.near_dedup import keep_one
from vellum.llm.quality_rules import keep_good
from vellum.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the fences of their language and source."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that loses all its lines goes."""
    kept = delete_repeated_runs(docs).where(~((F.col("n_removed") > 0) & (F.trim(F.translate("kept", "\t\n\x0b\x0c\r", " ")) == "")))
    shortened = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*(shortened[c].alias(c) if c in shortened else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_leaky(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the decoded bytes."""
    encoded = encode_and_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)
    return encoded.selectExpr("id AS doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "CAST(ids AS string) AS ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is made durable, as a job that writes and rereads it would."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
