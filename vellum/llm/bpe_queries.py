"""Query of byte-level BPE. SQL has no BPE; the query is tested against the tokenizer library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.byte_bpe import encode_and_decode

RANKS = "byte_bpe_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_and_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
