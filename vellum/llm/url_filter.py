"""URL filter: rules first, then naive Bayes over segmented words.

Rules name a host and a path prefix; the longest rule that fits decides. The rest
is judged by its words. Names such as ``bestcasinowin`` are split into words by
Viterbi over a unigram model; words of host and path go to a multinomial naive
Bayes classifier with two classes.

The unigram counts are those of all words of all pages, and of the parts of
hyphenated hosts and of paths; a seed that none of them shows counts once. Other
words are possible at a price that grows with their length. Classes are learned from
all pages by a seed list: a page whose words have a seed is an example of block, any
other of allow, so words that go along with seeds count too. All counts stay in
Spark tables, however many words there are: distinct names are split in blocks that
join only the words they contain, and splits and odds are joined back to pages.

Null URLs and those without ``://`` have an empty host and path, fit no rule and
are judged by the prior alone. Repeated rows count as often as they occur. Very
long names are segmented in linear time. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import durable

LONGEST = 20
#: Characters of distinct names that one task splits at a time.
BLOCK_CHARS = 20_000
#: Words that mark a page as unwanted.
SEEDS = ("adult", "ads", "bet", "bets", "bitcoin", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
CACHE = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. A rule is a host, a slash and a path prefix."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


class Segmenter:
    """Splits names into words by the most probable unigram path; ``total`` counts words beyond those given."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items() if n}
        self.unknown = math.log(total)
        self.cache: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self.cost and len(name) < 3:
            return [name]
        if (found := self.cache.get(name)) is not None:
            return found
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for size in range(1, min(LONGEST, end) + 1):
                price = self.cost.get(name[end - size : end])
                if price is None:
                    price = self.unknown + 2.5 * size
                options.append((best[end - size] + price, end - size))
            cost, at = min(options)
            best.append(cost)
            back.append(at)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[name] = words[::-1]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for name in names_of(host, path) for w in self.split(name)]


def names_of(host: str, path: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", f"{host} {path.lower()}")


def unigrams(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(word, n): counts of all words of all pages and of the parts of their URLs; a seed has at least 1."""
    shown = F.lower(F.regexp_replace(F.coalesce(F.col(html_column), F.lit("")), "<[^>]*>", " "))
    written = pages.select(F.explode(F.split(shown, r"[^\p{L}]+")).alias("word"))
    host, path = host_of(F.col(url_column)), F.lower(path_of(F.col(url_column)))
    labels = F.filter(F.split(host, r"\."), lambda x: F.contains(x, F.lit("-")))
    parts = pages.select(F.explode(F.split(F.concat_ws("-", F.array_join(labels, "-"), path), r"[^\p{L}]+")).alias("word"))
    words = written.unionAll(parts).where((F.col("word") != "") & (F.length("word") <= LONGEST)).select("word", F.lit(1).alias("k"))
    seeds = pages.sparkSession.createDataFrame([(w, 0) for w in SEEDS], "word string, k int")
    return words.unionAll(seeds).groupBy("word").agg(F.greatest(F.sum("k"), F.lit(1)).alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words): each distinct name with its split.

    Names are dealt to blocks of about BLOCK_CHARS; a block gets the counts of those
    words only that its names contain, so no task holds the dictionary.
    """
    total, chars = words.agg(F.sum("n")).first()[0], names.agg(F.sum(F.length("name"))).first()[0] or 0
    dealt = names.select("name", F.pmod(F.xxhash64("name"), F.lit(chars // BLOCK_CHARS + 1)).alias("block"))
    starts = dealt.select("block", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))
    parts = starts.select("block", F.explode(F.transform(sizes, lambda k: F.substring("name", F.col("at"), k))).alias("word")).distinct()
    known = parts.join(words, "word").groupBy("block").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("counts"))
    blocks = dealt.groupBy("block").agg(F.collect_list("name").alias("names")).join(known, "block", "left")

    def split(batches):
        for batch in batches:
            for block in batch.to_pylist():
                seg = Segmenter(dict(zip(block["known"] or (), block["counts"] or ())), total)
                split = [seg.split(x) for x in block["names"]]
                yield pa.RecordBatch.from_arrays([pa.array(block["names"], pa.string()), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return blocks.select("names", "known", "counts").mapInArrow(split, "name string, words array<string>")


def with_names(batches):
    for batch in batches:
        names = [names_of(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.list_(pa.string()))], [*batch.schema.names, "names"])


def in_order(rows: DataFrame, column: str, table: DataFrame, value: str) -> DataFrame:
    """(row, found): for each row the ``value`` of all elements of its array ``column``, in order, by the key of the same name less its s."""
    key = column.removesuffix("s")
    joined = rows.select("row", F.posexplode(column).alias("pos", key)).join(table.select(key, value), key)
    gathered = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("found"))
    return gathered.select("row", F.col(f"found.{value}").alias("found"))


def classify(pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, words, log_odds): one row per page."""
    url = F.col(url_column).cast("string")
    parts = pages.select(F.col(id_column).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    named = parts.mapInArrow(with_names, "id long, host string, path string, names array<string>")
    rows = durable(named.withColumn("row", F.monotonically_increasing_id()))
    names = durable(rows.select(F.explode("names").alias("name")).distinct())
    split = durable(segmented(names, durable(unigrams(pages, url_column, html_column))))
    bad = F.arrays_overlap("words", F.array(*map(F.lit, SEEDS)))
    examples = durable(in_order(rows, "names", split, "words").select("row", F.flatten("found").alias("words")).withColumn("blocked", bad))
    counted = durable(examples.select("blocked", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if(F.col("blocked")).alias("bad"), F.count_if(~F.col("blocked")).alias("good")))
    kinds, all_good, all_bad = counted.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    pages_bad, pages_all = examples.agg(F.count_if("blocked")).first()[0], rows.count()
    prior = math.log((pages_bad + 1) / (pages_all - pages_bad + 1))
    odds = counted.select("word", (F.log((F.col("bad") + 1) / (all_bad + kinds + 1)) - F.log((F.col("good") + 1) / (all_good + kinds + 1))).alias("odds"))
    scores = in_order(examples, "words", odds, "odds").select("row", F.aggregate("found", F.lit(0.0), lambda x, y: x + y).alias("score"))
    judged = examples.select("row", "words").join(scores, "row")
    scored = rows.drop("names").join(judged, "row", "left").select(
        "id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"), (F.lit(prior) + F.coalesce("score", F.lit(0.0))).alias("log_odds"))
    ruled = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else F.lit(None)
    own = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(ruled[F.col("rule")], own) if rules else own)
