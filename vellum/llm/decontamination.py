"""Benchmark decontamination by pigeonhole edit matching.

A test item leaks into a text if a part of the text is within its error budget, a
share of its length, in edit distance. An item with budget k is cut into k + 1
pieces: with at most k edits one piece stays whole. All pieces of all items are
found in one pass over each text (Aho-Corasick); around every hit the item is
verified with Myers' bit-parallel distance. Case and white space do not count.

An item below ``EXACT_CHARS`` characters after normalising has no room for errors: it
leaks where it stands as it is between word boundaries. Characters from U+2E80 on are
words of their own, since their scripts have no blanks.

The benchmark is the query set. Its items go to the tasks in blocks of bounded
size, one pass over the documents for each block; a block's leaks are written and the
block is released before the next one. Each text is judged alone, without any
shuffle but the one that gathers the answers of several blocks.

Null texts are empty. An item that is null or blank has nothing to be found and never
leaks. Items with a null id are searched like others and reported with a null id, one
entry each. Equal items are all reported. Extra columns are ignored. Empty tables give
no leaks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.rows import KEY, keyed, with_decision
from vellum.session import durable

BUDGET = 0.08
EXACT_CHARS = 24
OWN_WORD = "\u2e80"
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n = budget + 1
    edges = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """One item, ready for bit-parallel matching."""

    def __init__(self, text: str, share: float):
        self.text, self.size, self.exact = text, len(text), len(text) < EXACT_CHARS
        self.budget = 0 if self.exact else int(share * len(text))
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def nearest(self, text: str) -> tuple[int, int]:
        """(distance, end) of the part of ``text`` that is nearest to the item (Myers)."""
        full, top, masks = (1 << self.size) - 1, 1 << (self.size - 1), self.masks
        up, down, score = full, 0, self.size
        best, end = score, 0
        for k, c in enumerate(text, 1):
            same = masks.get(c, 0)
            step = (((same & up) + up) ^ up) | same | down
            more, less = down | (full & ~(step | up)), up & step
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best, end = score, k
            more, less = more << 1 & full, less << 1 & full
            same |= down
            up, down = less | (full & ~(same | more)), more & same
        return best, end


def joined(text: str, at: int) -> bool:
    """Whether the characters before and at a place belong to one word."""
    return 0 < at < len(text) and all(c.isalnum() and c < OWN_WORD for c in text[at - 1 : at + 1])


class Block:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], share: float):
        import ahocorasick

        self.items = [(key, Pattern(text, share)) for key, text in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, pattern) in enumerate(self.items):
            for at, piece in cut(pattern.text, pattern.budget):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in owners.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of every item in the text, at its nearest place."""
        windows: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                pattern = self.items[n][1]
                if pattern.exact:
                    if n not in whole and not joined(text, end + 1 - size) and not joined(text, end + 1):
                        whole[n] = end + 1
                    continue
                begin = end + 1 - size - at
                low, high = max(0, begin - pattern.budget), begin + pattern.size + pattern.budget
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1] - pattern.size + 2 * pattern.budget and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = [(self.items[n][0], 0, end) for n, end in whole.items()]
        for n, ranges in windows.items():
            key, pattern = self.items[n]
            best = min((distance, low + end) for low, high in ranges for distance, end in (pattern.nearest(text[low:high]),))
            if best[0] <= pattern.budget:
                found.append((key, *best))
        return sorted(found, key=lambda x: (x[0] is not None, *(v or 0 for v in x)))


def blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """Lists of (item id, normalised text) of bounded size; rows come one partition at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_column).cast("long").alias("k"), F.col(text_column).cast("string").alias("t")).toLocalIterator():
        text = normal(row["t"])
        if not text:
            continue
        held.append((row["k"], text))
        size += len(text)
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


LEAKS = "row_id long, row_hash long, id long, leaks array<struct<item_id: long, distance: int, stop: long>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("stop", pa.int64())]))


def search(shared):
    def run(batches):
        block = None
        for batch in batches:
            if block is None:
                block = Block(*shared.value)
            found = [[{"item_id": a, "distance": b, "stop": c} for a, b, c in block.leaks(normal(t.as_py()))] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEY, "id")), pa.array(found, _TYPE)], [*KEY, "id", "leaks"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, id_column: str = "doc_id", text_column: str = "text",
               item_id_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(row_id, row_hash, id, leaks): one row per input row."""
    rows, spark = keyed(docs, id_column, text_column), docs.sparkSession
    none = F.expr("CAST(array() AS array<struct<item_id: bigint, distance: int, stop: bigint>>)")
    pending, found = None, None
    for items in blocks(benchmark, item_id_column, item_text_column):
        if pending is not None:
            found = _settled(rows, pending, found, share)
        pending = items
    if found is None:  # one block or none: nothing to gather
        return rows.select(*KEY, "id", none.alias("leaks")) if pending is None else rows.mapInArrow(search(spark.sparkContext.broadcast((pending, share))), LEAKS)
    found = _settled(rows, pending, found, share)
    leaky = found.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leaks")))).alias("leaks"))
    return rows.select(*KEY, "id").join(leaky, KEY, "left").select(*KEY, "id", F.coalesce("leaks", none).alias("leaks"))


def _settled(rows: DataFrame, items: list, found: DataFrame | None, share: float) -> DataFrame:
    """The leaks of one more block, written, so that its broadcast can go."""
    shared = rows.sparkSession.sparkContext.broadcast((items, share))
    more = durable(rows.mapInArrow(search(shared), LEAKS).where(F.size("leaks") > 0))
    shared.destroy()
    return more if found is None else found.unionAll(more)


def drop_leaky(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without a leak, with all their columns."""
    leaks = find_leaks(docs, benchmark, id_column=id_column, text_column=text_column).where(F.size("leaks") > 0)
    leaky = leaks.groupBy(*KEY).agg(F.lit(True).alias("leaky"))
    return with_decision(docs, leaky, "leaky", id_column, text_column).where("leaky IS NULL").select("row.*")
