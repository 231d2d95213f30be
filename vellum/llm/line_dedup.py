"""Line deduplication: later copies of repeated line runs go, the first stays.

Texts are sequences of line ids, an id being a 128-bit hash of a line. Suffixes of
these sequences are ranked by prefix doubling: the rank over 2k lines is made of
the ranks over k lines at a position and k lines on. Equal ranks over
``min_lines`` lines are an interval of the suffix array whose common prefix is at
least that long. In each interval all suffixes but the first in text order start
a later copy; overlapping copies add up to the maximal repeated runs, which are
deleted line by line. Lines that occur once end every run, so they leave first.

A run counts if it has ``min_lines`` lines or one line of ``min_words`` words, so a
long line that stands between unique ones, or is a whole text, is a run by itself:
the intervals over one line are read for such lines, those over ``min_lines`` for
all. Words are what stands between ASCII white space.

Everything is DataFrame operations. Counts and first places are aggregates with
map-side combine, so a line in a third of all rows makes no large group; joins
have one row per id on one side, and the adaptive skew join splits the other.

Text order is by id, then a hash of the text, then line. Lines without a word take
no part and stay. Null and empty texts have no lines to lose; a null text stays
null. Rows that repeat an id and a text are one document. Extra columns are
returned as they are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.rows import KEY, keyed, with_decision
from vellum.session import durable

MIN_LINES = 2
MIN_WORDS = 5
HAS_WORD = r"[^\x20\x09-\x0D]"


def has_words(n: int) -> str:
    """Pattern of a line with ``n`` words or more."""
    return rf"({HAS_WORD}+[\x20\x09-\x0D]+){{{n - 1}}}{HAS_WORD}"


def line_ids(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_id, row_hash, seq, line, a, b, long): lines with a word, numbered among themselves, with their 128-bit ids."""
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("said"))), lambda x: x["said"].rlike(HAS_WORD))
    parts = rows.select(*KEY, F.posexplode(worded).alias("seq", "x"))
    named = parts.select(*KEY, "seq", F.col("x.line").alias("line"), F.xxhash64("x.said").alias("a"), F.xxhash64(F.lit(7), "x.said").alias("b"), F.col("x.said").rlike(has_words(min_words)).alias("long"))
    return named.dropDuplicates([*KEY, "seq"])


def repeated(suffixes: DataFrame) -> DataFrame:
    """Only suffixes whose rank (a, b) another one shares."""
    shared = suffixes.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    return suffixes.join(shared, ["a", "b"])


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks over ``step`` more lines: join each suffix to the one ``step`` lines on."""
    after = ranks.select(*KEY, (F.col("seq") - step).alias("seq"), F.col("a").alias("c"), F.col("b").alias("d"))
    pair = [F.col(x) for x in ("a", "b", "c", "d")]
    return ranks.join(after, [*KEY, "seq"]).select(*KEY, "seq", F.xxhash64(*pair).alias("a"), F.xxhash64(F.lit(7), *pair).alias("b"))


def later_copies(suffixes: DataFrame, length: int) -> DataFrame:
    """(row_id, row_hash, seq) of the lines under all suffixes of an interval over ``length`` lines but its first."""
    place = F.struct(*KEY, "seq")
    first = suffixes.groupBy("a", "b").agg(F.min(place).alias("first"))
    later = suffixes.join(first, ["a", "b"]).where(place != F.col("first"))
    return later.select(*KEY, F.explode(F.sequence("seq", F.col("seq") + length - 1)).alias("seq"))


def later_lines(lines: DataFrame, min_lines: int) -> DataFrame:
    """(row_id, row_hash, seq) of every line that a later copy of a run covers."""
    ranks, length = durable(repeated(lines.select(*KEY, "seq", "a", "b", "long"))), 1
    single = ranks.where("long")
    while length < min_lines:
        step = min(length, min_lines - length)
        ranks, length = durable(repeated(doubled(ranks, step))), length + step
    return later_copies(single, 1).union(later_copies(ranks, min_lines)).distinct()


def delete_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """struct ``row`` (the input row), ``kept`` (its text without later copies), n_lines, n_removed, n_runs; one per input row."""
    lines = line_ids(keyed(docs, id_column, text_column), min_words)
    gone = later_lines(lines, min_lines).groupBy(*KEY).agg(F.collect_list("seq").alias("gone"))
    joined = with_decision(docs, gone, "gone", id_column, text_column)
    split = joined.select("row", F.coalesce("gone", F.expr("CAST(array() AS array<int>)")).alias("gone"), F.split(F.col(f"row.`{text_column}`").cast("string"), "\n").alias("lines"))
    placed = split.select("row", "lines", F.expr("array_sort(gone)").alias("gone"), F.expr(
        f"CASE WHEN size(gone) > 0 THEN filter(transform(lines, (x, i) -> CASE WHEN x RLIKE r'{HAS_WORD}' THEN i END), i -> i IS NOT NULL) END").alias("worded"))
    removed = placed.select("row", "lines", "gone", F.expr("transform(gone, k -> worded[k])").alias("cut"))
    kept = F.expr("CASE WHEN size(cut) = 0 THEN array_join(lines, '\\n') ELSE array_join(transform(array_except(sequence(0, size(lines) - 1), cut), i -> lines[i]), '\\n') END")
    return removed.select(
        "row", kept.alias("kept"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("cut").cast("long").alias("n_removed"),
        F.size(F.expr("filter(gone, (k, j) -> j = 0 OR gone[j - 1] < k - 1)")).cast("long").alias("n_runs"))
