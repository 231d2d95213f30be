"""Near-duplicate classes by BagMinHash signatures over multisets of word shingles.

A text is the multiset of its five-word shingles. BagMinHash signs it without
bias for the weighted Jaccard similarity: each shingle has a Poisson process over
time and weight; a point counts if its weight coordinate is at most the shingle's
multiplicity, and each register keeps the earliest point that fell to it. The
weights are discretised by doubling intervals, (0, 1], (1, 2], (2, 4] and so on,
and the process of an interval is only drawn for shingles that reach it and only
until it can no longer lower a register, which makes large weights cheap.

Two texts agree in a register with probability J. Rows with one sequence of words
collapse first. Bands of registers deal the distinct texts to buckets. Comparing
all pairs of a bucket would be quadratic, so:

1. Each bucket picks as its centre the text whose buckets are largest in sum (of
   a text and its edited copies that is the original), and every other member is
   compared with it. That is one pair per member and bucket.
2. Confirmed pairs are joined to components. Members of a bucket outside its most
   frequent component (strays) are compared with all members of other components,
   because only such pairs can still join anything. In a bucket of up to 64 texts
   all such pairs are confirmed like the others.
   Larger buckets with one main component are merged to a family, so a pair that
   meets in many bands is compared once. Families are cut into blocks of 512
   strays by 512 members; a task compares a pair of blocks exactly, by one matrix
   product over the shingles that two of its texts share, and hands on a spanning
   forest of the similar pairs, never the pairs.

Every link is confirmed on the exact multisets. Rows per shuffle are bounded by
bands times texts in step 1 and, in step 2, by texts times blocks of strays.

With 24 bands of 4 registers a pair of similarity 0.8 misses all bands with
probability 3e-6. Texts of one to four words are one shingle. Null texts and texts
without a word have no shingles: each is a class of its own. Rows that repeat an
id and a text are in one class. Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import minimisers as M
from vellum.llm.components import components
from vellum.llm.rows import KEY, key_columns, keyed, real_id, with_decision
from vellum.session import durable

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
PIECE = 1 << 21
#: Texts of a bucket up to which pairs are compared one by one, texts of a block, columns of a matrix.
SMALL, BLOCK, COLUMNS = 64, 512, 4096


def multiset(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, multiplicities) of the shingles of a text."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = min(SHINGLE, len(words))
    units = M.Words(size, size)
    buffer = b" ".join(words)
    return np.unique(units.grams(buffer, *units.units(buffer)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 0.0


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash registers (times of the earliest points) of n multisets given as (owner, hash, weight) entries."""
    level = np.zeros(len(weights), np.int64)
    level[weights > 1] = np.ceil(np.log2(weights[weights > 1])).astype(np.int64)
    entry = np.repeat(np.arange(len(weights)), level + 1)
    depth = np.arange(len(entry)) - np.repeat(np.append(0, np.cumsum(level + 1)[:-1]), level + 1)
    base = np.where(depth > 0, 1 << np.maximum(depth - 1, 0), 0)
    width = np.maximum(base, 1)
    reach = (weights[entry] - base) / width  # part of the interval below the weight
    state = M.mix(hashes[entry] + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row, rate = owner[entry], width.astype(np.float64)
    time = np.zeros(len(entry))
    registers = np.full(n * REGISTERS, np.inf)
    while len(state):
        state = state + np.uint64(0xD1342543DE82EF95)
        draw = M.mix(state.copy())
        time = time + -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        draw = M.mix(draw)
        inside = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 <= reach
        place = row * REGISTERS + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % REGISTERS
        np.minimum.at(registers, place[inside], time[inside])
        on = time < registers.reshape(n, REGISTERS).max(axis=1)[row]
        state, time, row, rate, reach = state[on], time[on], row[on], rate[on], reach[on]
    return registers.reshape(n, REGISTERS)


SIGNED = "row_id long, row_hash long, words binary, bands array<long>"


def sign(batches):
    """(key, digest of the word sequence, band keys) of every row; nulls where it has no word."""
    def close(held):
        entries = [x for x in held if len(x[3][0])]
        owner = np.repeat(np.arange(len(entries)), [len(x[3][0]) for x in entries])
        bands = {}
        if entries:
            signed = signatures(np.concatenate([x[3][0] for x in entries]), np.concatenate([x[3][1] for x in entries]), owner, len(entries))
            bits = M.mix(signed.view(np.uint64).copy())
            keys = np.zeros((len(entries), BANDS), np.uint64)
            for k in range(ROWS):
                keys = M.mix(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
            for (row_id, row_hash, _, _), key in zip(entries, keys.view(np.int64).tolist()):
                bands[row_id, row_hash] = key
        names = [(x[0], x[1]) for x in held]
        return pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.binary()),
            pa.array([bands.get(k) for k in names], pa.list_(pa.int64())),
        ], [*KEY, "words", "bands"])

    for batch in batches:
        held, size = [], 0
        for row_id, row_hash, text in zip(batch["row_id"].to_pylist(), batch["row_hash"].to_pylist(), batch["text"]):
            words = text.as_py().encode().split()
            held.append((row_id, row_hash, hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None, multiset(words)))
            size += 8 * len(words)
            if size > PIECE:
                yield close(held)
                held, size = [], 0
        if held:
            yield close(held)


def grouped(batches, key: list[str]):
    """Lists of rows (dicts) of a partition that is sorted by ``key``."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = [row[k] for k in key]
            if at != now and rows:
                yield rows
                rows = []
            now = at
            rows.append(row)
    if rows:
        yield rows


def _pairs(found: list) -> pa.RecordBatch:
    kind = pa.struct([("row_id", pa.int64()), ("row_hash", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], ["u", "v"])


def compare_small(batches):
    """Of each small bucket all pairs of different components."""
    found = []
    for rows in grouped(batches, ["bucket"]):
        found += [(a["node"], b["node"]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a["component"] != b["component"]]
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def common_counts(bags: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the multiset intersections of texts ``left`` and ``right``.

    The k-th copy of a shingle is an element of its own. Elements that only one
    text has cannot be common; the others become columns of a 0/1 matrix, a
    bounded number at a time.
    """
    elements = [M.mix(np.repeat(h, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) for h, n in bags]
    owner = np.repeat(np.arange(len(bags)), [len(e) for e in elements])
    _, column, n = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        has = np.zeros((len(bags), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        common += has[left] @ has[right].T
    return common


def link_blocks(batches):
    """A spanning forest of the similar pairs between the strays and the members of each pair of blocks."""
    for rows in grouped(batches, ["family", "i", "j"]):
        nodes: dict[tuple, dict] = {}
        for r in rows:
            nodes.setdefault((r["node"]["row_id"], r["node"]["row_hash"]), r)
        place = {k: n for n, k in enumerate(nodes)}
        roles = [np.array(sorted({place[r["node"]["row_id"], r["node"]["row_hash"]] for r in rows if r["stray"] == role}), np.int64) for role in (True, False)]
        if not len(roles[0]) or not len(roles[1]):
            continue
        known = list(nodes.values())
        bags = [multiset(r["text"].encode().split()) for r in known]
        size = np.array([b[1].sum() for b in bags], np.float64)
        common = common_counts(bags, *roles).astype(np.float64)
        near = common >= SIMILAR * (size[roles[0]][:, None] + size[roles[1]][None] - common)
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        component = [tuple(r["component"].values()) for r in known]
        found = []
        for a, b in zip(*np.nonzero(near)):
            u, v = roles[0][a], roles[1][b]
            x, y = find(component[u]), find(component[v])
            if x != y:
                parent[x] = y
                found.append((known[u]["node"], known[v]["node"]))
        if found:
            yield _pairs(found)


def confirm(batches):
    """Pairs of texts whose exact similarity is high enough."""
    last: dict[str, tuple] = {}

    def bag(text):
        if text not in last:
            if len(last) >= 16:
                last.clear()
            last[text] = multiset(text.encode().split())
        return last[text]

    for batch in batches:
        keep = [similarity(bag(a.as_py()), bag(b.as_py())) >= SIMILAR for a, b in zip(batch["text_u"], batch["text_v"])]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


PAIR = "u struct<row_id: long, row_hash: long>, v struct<row_id: long, row_hash: long>"


#: Distinct texts for each task of the steps between the passes over all rows.
ROWS_PER_TASK = 10_000


def confirmed(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Of distinct pairs (u, v) those whose texts are similar; only texts in a pair are read."""
    nodes = pairs.select("u").unionAll(pairs.select("v")).distinct()
    node = F.struct(*KEY)
    needed = durable(texts.select(node.alias("u"), "text").join(nodes, "u").dropDuplicates(["u"]).coalesce(parts))
    left = pairs.join(needed.withColumnRenamed("text", "text_u"), "u")
    both = left.join(needed.select(F.col("u").alias("v"), F.col("text").alias("text_v")), "v")
    return durable(both.select("u", "v", "text_u", "text_v").coalesce(parts).mapInArrow(confirm, PAIR))


def in_order(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *columns).dropDuplicates(["u", "v"])


def family_links(labelled: DataFrame, large: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links that strays of large buckets add; ``large`` has (bucket, main)."""
    members = durable(labelled.join(large, "bucket").select(F.col("main").alias("family"), "node", "component").distinct().coalesce(parts))
    stray = F.col("component") != F.col("family")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.count_if(stray).alias("s"))
    block = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK))
    draw = F.xxhash64("node")
    placed = members.join(sizes, "family").select(
        "family", "node", "component", stray.alias("is_stray"), block("s").cast("int").alias("across"), block("n").cast("int").alias("down"),
        F.pmod(draw, block("s")).cast("int").alias("own_i"), F.pmod(draw, block("n")).cast("int").alias("own_j"))
    as_member = placed.select("family", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), F.col("own_j").alias("j"), "node", "component", F.lit(False).alias("stray"))
    as_stray = placed.where("is_stray").select("family", F.col("own_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), "node", "component", F.lit(True).alias("stray"))
    needed = durable(texts.select(F.struct(*KEY).alias("node"), "text").join(members.select("node").distinct(), "node").dropDuplicates(["node"]).coalesce(parts))
    key = ["family", "i", "j"]
    units = as_member.unionAll(as_stray).join(needed, "node").repartition(*key).sortWithinPartitions(*key)
    return units.select(*key, "node", "component", "stray", "text").mapInArrow(link_blocks, PAIR)


def similar_links(nodes: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links (u, v) that connect all similar texts among the distinct ``nodes`` (node, bands)."""
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(dealt.join(full, "bucket").coalesce(parts))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    star = in_order(members.join(centre, "bucket").select(F.col("node").alias("u"), F.col("centre").alias("v")))
    star = durable(star.coalesce(parts))
    links = confirmed(star, texts, parts)

    labelled = durable(members.join(components(links), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component")).coalesce(parts))
    sizes = labelled.groupBy("bucket", "n", "component").agg(F.count("*").alias("size"))
    mixed = durable(sizes.groupBy("bucket", "n").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").coalesce(parts))
    few = labelled.join(mixed.where(F.col("n") <= SMALL).select("bucket"), "bucket")
    dealt_few = few.select("bucket", "node", "component").repartition("bucket").sortWithinPartitions("bucket")
    near = in_order(dealt_few.mapInArrow(compare_small, PAIR)).join(star, ["u", "v"], "left_anti")
    more = confirmed(durable(near.coalesce(parts)), texts, parts)
    large = mixed.where(F.col("n") > SMALL).select("bucket", "main")
    return links.unionAll(more).unionAll(durable(family_links(labelled.drop("n"), large, texts, parts)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row_id, row_hash, id, class_row, class_hash): one row per input row. A class is named by its least (id, text hash)."""
    rows = keyed(docs, id_column, text_column)
    signed = durable(rows.select(*KEY, "text").mapInArrow(sign, SIGNED))
    node = F.struct(*KEY)
    # The least row of each word sequence stands for all of them.
    leaders = durable(signed.where("words IS NOT NULL").groupBy("words").agg(F.min(node).alias("node"), F.min_by("bands", node).alias("bands")))
    parts = 1 + leaders.count() // ROWS_PER_TASK
    joined = components(similar_links(leaders.coalesce(parts), rows, parts))
    named = leaders.select("words", "node").join(joined, "node", "left").select("words", F.coalesce("component", "node").alias("class"))
    found = signed.select(*KEY, "words").join(named, "words", "left")
    own = F.coalesce("class", F.struct(*KEY))
    return found.select(*KEY, real_id("row_id").alias("id"), own["row_id"].alias("class_row"), own["row_hash"].alias("class_hash"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, the one with the least id, with all its columns; of repeated rows one stays."""
    classes = near_duplicates(docs, id_column, text_column)
    first = classes.where("row_id = class_row AND row_hash = class_hash").select(*KEY, F.lit(True).alias("first")).distinct()
    kept = with_decision(docs, first, "first", id_column, text_column).where("first")
    k, h = key_columns(f"row.`{id_column}`", f"row.`{text_column}`")
    return kept.select("row", k.alias("k"), h.alias("h")).dropDuplicates(["k", "h"]).select("row.*")
