"""Query of the quality rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import quality_rules as Q


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = Q.quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return verdicts.selectExpr(
        "id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIMITS = " ".join(f"WHEN '{m}' THEN {v}" for m, v in Q.METRICS.items())
_HALF = r"[^\x20\x09-\x0D]"
OP10_SQL = rf"""
WITH split AS (
    SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{_HALF}+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_HALF}')) AS lines
    FROM documents),
windows AS (
    SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
hits AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM windows),
repeated AS (
    SELECT r, count(DISTINCT i + d) AS n FROM hits, (VALUES (0), (1), (2)) AS t(d) WHERE n > 1 GROUP BY r),
counted AS (
    SELECT doc_id, lang, source, s.r, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '{Q.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
    FROM split s LEFT JOIN repeated p ON s.r = p.r),
measured AS (
    SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
           least({Q.TOP_BIN}, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)) AS symbol,
           least({Q.TOP_BIN}, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)) AS dup_line,
           least({Q.TOP_BIN}, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)) AS "repeat",
           least({Q.TOP_BIN}, coalesce(10 * word_chars // nullif(n_words, 0), 0)) AS word_length
    FROM counted),
pairs AS (
    SELECT lang, source, unnest(['symbol', 'dup_line', 'repeat', 'word_length']) AS metric,
           unnest([symbol, dup_line, "repeat", word_length]) AS bin
    FROM measured WHERE NOT base_failed),
levels AS (
    SELECT 0 AS level, lang, source, metric, bin FROM pairs UNION ALL SELECT 1, lang, NULL, metric, bin FROM pairs
    UNION ALL SELECT 2, NULL, NULL, metric, bin FROM pairs),
limits AS (
    SELECT level, lang, source, metric, count(*) AS total, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3
    FROM levels GROUP BY ALL),
fences AS (
    SELECT level, lang, source, metric, q1 - {Q.FENCE} * greatest(q3 - q1, CASE metric {_LIMITS} END) AS low,
           q3 + {Q.FENCE} * greatest(q3 - q1, CASE metric {_LIMITS} END) AS high
    FROM limits WHERE level = 2 OR total >= {Q.MIN_GROUP}),
long AS (
    SELECT r, lang, source, unnest(['symbol', 'dup_line', 'repeat', 'word_length']) AS metric,
           unnest([symbol, dup_line, "repeat", word_length]) AS bin
    FROM measured),
outside AS (
    SELECT r, bool_or(bin > coalesce(a.high, b.high, c.high) OR bin < coalesce(a.low, b.low, c.low)) AS outside
    FROM long x
    LEFT JOIN fences a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source AND a.metric = x.metric
    LEFT JOIN fences b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM x.lang AND b.metric = x.metric
    LEFT JOIN fences c ON c.level = 2 AND c.metric = x.metric
    GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM measured m LEFT JOIN outside o ON m.r = o.r
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": OP10_SQL}
