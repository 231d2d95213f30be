"""Quality rules whose thresholds adapt to each language and source.

Fixed base rules reject short and repetitive texts. The other limits are fences
around what is usual in the same language and source. The distribution behind a
fence is a histogram sketch: counts of whole-number bins. Sketches of parts are
merged by adding counts, so they are built with map-side combine, need at most
1,001 counters for a metric and group, do not depend on the order of rows, and
give a quantile that is off by less than one bin. A group with few rows takes
the merged sketch of its language, and a small language that of all rows.

Null and empty texts have no words and fail the base rule. Null languages and
sources form groups of their own. Repeated rows count as often as they occur.
An empty table gives no rows. Columns beyond id, text, language and source are
ignored here; ``keep_good`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.rows import KEY, key_columns, with_decision
from vellum.session import durable

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TOP_BIN = 1000
MIN_GROUP = 200
FENCE = 3
#: Metric, and the least spread that its fence assumes, in bins.
METRICS = {"symbol": 15, "dup_line": 60, "repeat": 60, "word_length": 8}


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             source_column: str = "source") -> DataFrame:
    """Counts of every whole text, by built-in array functions of the row alone.

    Repeated words are found by sorting the hashes of a text's three-word windows
    next to their positions; only texts with an equal pair of hashes sort.
    """
    row_id, row_hash = key_columns(id_column, text_column)
    base = docs.select(
        row_id.alias("row_id"), row_hash.alias("row_hash"), F.col(id_column).cast("long").alias("id"), F.col(lang_column).alias("lang"),
        F.col(source_column).alias("source"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    split = base.select(
        *KEY, "id", "lang", "source",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *KEY, "id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>)
                  ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END""").alias("windows"),
    )
    rows = [*KEY, "id", "lang", "source", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    ordered = hashed.select(
        *rows,
        F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
                  THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END""").alias("ordered"),
    )
    repeated = ordered.select(
        *rows,
        F.expr("""sort_array(transform(filter(ordered, (w, j) -> w.h <=> get(ordered, j - 1).h OR w.h <=> get(ordered, j + 1).h), w -> w.i))""").alias("at"),
    )
    return repeated.select(
        *rows,
        F.expr("""CASE WHEN at IS NULL THEN 0L
                  ELSE CAST(aggregate(sequence(1, size(at) - 1), 3, (n, j) -> n + least(3, at[j] - at[j - 1])) AS bigint) END""").alias("n_repeat_words"),
    )


def metrics(counted: DataFrame) -> DataFrame:
    """Add the base verdict and the whole-number metrics, each from 0 to 1,000."""
    return counted.selectExpr(
        "*",
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed",
        "coalesce(try_divide(1000 * n_symbols, word_chars), 0) AS symbol_rate",
        "coalesce(try_divide(1000 * n_dup_lines, n_lines), 0) AS dup_line_rate",
        "coalesce(try_divide(1000 * n_repeat_words, n_words), 0) AS repeat_rate",
        "coalesce(try_divide(10 * word_chars, n_words), 0) AS length_rate",
    ).selectExpr(
        *counted.columns, "base_failed",
        *(f"least({TOP_BIN}, CAST(floor({a}_rate) AS int)) AS {b}" for a, b in zip(("symbol", "dup_line", "repeat", "length"), METRICS)),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): one mergeable histogram for each group and metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in METRICS))).alias("x")
    return measured.where("NOT base_failed").select("lang", "source", pairs).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, low, high) of each group, language and the whole, with enough rows."""
    sketch.createOrReplaceTempView("llm_quality_sketch")
    floors = " ".join(f"WHEN '{m}' THEN {v}" for m, v in METRICS.items())
    return sketch.sparkSession.sql(f"""
        WITH merged AS (
            SELECT 0 AS level, lang, source, metric, bin, n FROM llm_quality_sketch
            UNION ALL SELECT 1, lang, NULL, metric, bin, SUM(n) FROM llm_quality_sketch GROUP BY lang, metric, bin
            UNION ALL SELECT 2, NULL, NULL, metric, bin, SUM(n) FROM llm_quality_sketch GROUP BY metric, bin),
        ranked AS (
            SELECT *, SUM(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto,
                   SUM(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM merged),
        quartiles AS (
            SELECT level, lang, source, metric, MAX(total) AS total,
                   MIN(CASE WHEN 4 * upto >= total THEN bin END) AS q1, MIN(CASE WHEN 4 * upto >= 3 * total THEN bin END) AS q3
            FROM ranked GROUP BY level, lang, source, metric)
        SELECT level, lang, source, metric, q1 - {FENCE} * greatest(q3 - q1, CASE metric {floors} END) AS low,
               q3 + {FENCE} * greatest(q3 - q1, CASE metric {floors} END) AS high
        FROM quartiles WHERE level = 2 OR total >= {MIN_GROUP}""")


def wide(limits: DataFrame) -> DataFrame:
    """One row per (level, lang, source) with a low and a high limit for every metric."""
    return limits.groupBy("level", "lang", "source").agg(
        *(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in METRICS for side in ("low", "high")))


def quality_verdicts(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per document: key, id, counts, base_failed and kept."""
    measured = durable(metrics(features(docs, **columns)))
    limits = durable(wide(fences(sketches(measured))).coalesce(1))
    names = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]

    def level(n: int, *keys: str) -> DataFrame:
        return limits.where(F.col("level") == n).select(*(F.col(k).alias(f"k_{k}{n}") for k in keys), F.struct(*names).alias(f"limits{n}"))

    own, lang, whole = level(0, "lang", "source"), level(1, "lang"), level(2)
    judged = (
        measured.join(own, measured.lang.eqNullSafe(own.k_lang0) & measured.source.eqNullSafe(own.k_source0), "left")
        .join(lang, measured.lang.eqNullSafe(lang.k_lang1), "left").join(whole, F.lit(True), "left")
        .withColumn("limits", F.coalesce("limits0", "limits1", "limits2"))
    )
    outside = " OR ".join(f"{m} > limits.{m}_high OR {m} < limits.{m}_low" for m in METRICS)
    return judged.selectExpr(
        *KEY, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"NOT base_failed AND NOT coalesce({outside}, false) AS kept",
    )


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows that are kept, with all their columns."""
    verdicts = quality_verdicts(docs, **columns).groupBy(*KEY).agg(F.bool_and("kept").alias("kept"))
    text = {k: v for k, v in columns.items() if k in ("id_column", "text_column")}
    return with_decision(docs, verdicts, "kept", **text).where("kept").select("row.*")
