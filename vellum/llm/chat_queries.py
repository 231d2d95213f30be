"""Query of chat formatting and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.chat_format import digest_conversations, format_turns, text_parts

TRICKY = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_turns(given.unionByName(added).withColumn("parts", text_parts(F.col("text")))))


OP6_SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}')),
formatted AS (
    SELECT *, '<turn ' || replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), ' ', '\s')
        || CASE WHEN role = 'assistant' THEN ' loss' ELSE '' END || '>' || chr(10)
        || replace(replace(text, '\', '\\'), '<', '\l') || chr(10) || '</turn>' || chr(10) AS formatted
    FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, formatted)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""

QUERIES = {"op6_chat_formatting": op6_chat_formatting}
ORACLES = {"op6_chat_formatting": OP6_SQL}
