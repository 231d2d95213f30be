"""Merkle manifest of a dataset, whose parents keep SHA midstates.

Every row is a leaf; the leaves of a group, in order, are hashed in runs of
``arity`` until one digest is left, the subroot, and the subroots, in order of
their groups, are hashed the same way to the root. While a parent is hashed, a copy
of its hash state is kept before each child slot. To fold a replaced child, the state
before its slot is resumed with the replacement and the right siblings only; what
stands to the left is never hashed again.

Only digests are shuffled. Leaves are numbered over range partitions and cut into
aligned chunks of ``arity ** height`` leaves. A chunk is a subtree of its own, so each
tier shrinks the table by that factor, and a few tiers reach the root at any size.
The chunks above a leaf's own hand down its left and right siblings; their states are
resumed from the left ones once per chunk. Numbered tables are made durable, so a
lost task sees the same places again.

A null value is written ``-``. Null groups come first, null ids come first in their
group and are never tampered with; rows of one id are in order of their leaves, so
repeated rows are leaves of their own with places that may be exchanged. Empty texts
are ``0:``. A text of any length is hashed by its task and not sent. Extra columns
are ignored. An empty table has no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ordering import numbered
from vellum.session import durable

ARITY = 2
#: Levels of one chunk: with two children a chunk has 4,096 leaves.
HEIGHT = 12

STEPS = "array<struct<before: array<string>, after: array<string>>>"
CHUNK_ROOT = "key string, at long, total long, node string"
TRAIL = f"key string, at long, chunk long, steps {STEPS}"
FOLDED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_STEP = pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def leaf_text(*values: Column) -> Column:
    """Each value as ``-`` or its byte count, a colon and itself, without anything between."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values))


def levels_of(total: int, arity: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


class Subtree:
    """The levels of one chunk, with the hash states of every parent before each of its slots."""

    def __init__(self, nodes: list[bytes], arity: int, height: int):
        self.arity, self.levels, self.states = arity, [nodes], []
        for _ in range(height):
            below, parents, states = self.levels[-1], [], []
            for first in range(0, len(below), arity):
                running, kept = hashlib.sha256(), []
                for child in below[first : first + arity]:
                    kept.append(running.copy())
                    running.update(child)
                parents.append(running.hexdigest().encode())
                states.append(kept)
            self.levels.append(parents)
            self.states.append(states)

    def siblings(self, at: int):
        """(left, right) siblings of a node and its ancestors, from below."""
        for nodes in self.levels[:-1]:
            first = at - at % self.arity
            yield nodes[first:at], nodes[at + 1 : first + self.arity]
            at //= self.arity

    def fold(self, at: int, replacement: bytes) -> bytes:
        """The digest on top of the chunk with one leaf replaced."""
        for nodes, states in zip(self.levels, self.states):
            parent, slot = divmod(at, self.arity)
            resumed = states[parent][slot].copy()
            resumed.update(replacement)
            for right in nodes[at + 1 : (parent + 1) * self.arity]:
                resumed.update(right)
            replacement, at = resumed.hexdigest().encode(), parent
        return replacement


def _chunk(table: pa.Table, arity: int, height: int) -> tuple[pa.Table, Subtree, int]:
    table = table.sort_by("at")
    levels = min(height, levels_of(table["total"][0].as_py(), arity))
    return table, Subtree([x.encode() for x in table["node"].to_pylist()], arity, levels), levels


def _chunked(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    return nodes.withColumn("chunk", F.expr(f"at div {arity**height}"))


def climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Tiers of (key, at, total, node) from the given nodes up to one node per key; ``total`` counts the nodes of the key in its tier."""
    def top(table: pa.Table) -> pa.Table:
        table, tree, levels = _chunk(table, arity, height)
        total = -(-table["total"][0].as_py() // arity**levels)
        return pa.table({"key": [table["key"][0].as_py()], "at": [table["chunk"][0].as_py()], "total": [total], "node": [tree.levels[-1][0].decode()]})

    tiers = [nodes]
    while True:
        tiers.append(durable(_chunked(tiers[-1], arity, height).groupBy("key", "chunk").applyInArrow(top, CHUNK_ROOT)))
        if (tiers[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return tiers


def descend(tiers: list[DataFrame], above: DataFrame, arity: int, height: int) -> DataFrame:
    """Siblings on the way up of each node of the second tier, as (key, at, steps, …): ``above`` has one row (key, steps, …) per key."""
    def trails(table: pa.Table) -> pa.Table:
        table, tree, _ = _chunk(table, arity, height)
        steps = [[{"before": [x.decode() for x in a], "after": [x.decode() for x in b]} for a, b in tree.siblings(k)] for k in range(table.num_rows)]
        return table.select(["key", "at", "chunk"]).append_column("steps", pa.array(steps, pa.list_(_STEP)))

    path = above.withColumn("at", F.lit(0).cast("long"))
    for nodes in reversed(tiers[1:-1]):
        own = _chunked(nodes, arity, height).groupBy("key", "chunk").applyInArrow(trails, TRAIL)
        upper = path.withColumnsRenamed({"at": "chunk", "steps": "upper"})
        path = own.join(upper, ["key", "chunk"]).withColumn("steps", F.concat("steps", "upper")).drop("chunk", "upper")
    return path


def _fold_chunk(arity: int, height: int):
    def run(leaves: pa.Table, paths: pa.Table) -> pa.Table:
        leaves, tree, _ = _chunk(leaves, arity, height)
        path = paths.to_pylist()[0]
        resumed, tail = [], []
        for step in path["steps"]:
            state = hashlib.sha256("".join(step["before"]).encode())
            resumed.append((state, "".join(step["after"]).encode()))
            tail += step["before"] + step["after"]
        tail = "".join(tail).encode()
        roots: dict[bytes, str] = {}

        def to_root(node: bytes) -> str:
            if node not in roots:
                folded = node
                for state, after in resumed:
                    state = state.copy()
                    state.update(folded + after)
                    folded = state.hexdigest().encode()
                roots[node] = folded.decode()
            return roots[node]

        rows = []
        for k, (number, leaf, replaced) in enumerate(zip(leaves["id"].to_pylist(), tree.levels[0], leaves["replaced"].to_pylist())):
            proof = hashlib.sha256(b"".join([x for pair in tree.siblings(k) for side in pair for x in side]) + tail).hexdigest()
            folded = to_root(tree.fold(k, replaced.encode() if replaced is not None else leaf))
            rows.append((number, leaf.decode(), path["subroot"], path["root"], proof, folded, folded == path["root"]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FOLDED.split(", ")])

    return run


def manifest(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Fold every row of (grp string, id long, leaf string, replaced string) into the root of all rows.

    ``replaced`` is the leaf after a change, or null for none. Returns id, leaf, the
    subroot of its group, the root, a digest of the siblings on its way, the root
    folded from the replacement and the original siblings, and whether it is the root.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())  # equal rows: any order, but not one partition
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("key"), "id", F.col("leaf").alias("node"), "replaced")
    placed = numbered(keyed, ["key"], ["id", "node", spread])
    totals = placed.groupBy("key").agg(F.max("row_number").alias("total"))
    nodes = durable(placed.join(totals, "key").selectExpr("key", "id", "replaced", "node", "row_number - 1 AS at", "total"))
    tiers = climb(nodes.select("key", "at", "total", "node"), arity, height)

    subroots = tiers[-1].selectExpr("key AS of", "node")
    groups = subroots.count()
    ranked = numbered(subroots, [], ["of"], partitions=1 + groups // 2**16)
    placed = durable(ranked.select(F.lit("").alias("key"), "of", "node", (F.col("row_number") - 1).alias("at"), F.lit(groups).cast("long").alias("total")))
    over = climb(placed.select("key", "at", "total", "node"), arity, height)
    root = over[-1].selectExpr("key", f"CAST(array() AS {STEPS}) AS steps", "node AS root")
    # the trail of each subroot: that of its chunk, after its own inside the chunk
    own = descend([None, placed.select("key", "at", "total", "node"), *over[1:]], root, arity, height)
    named = own.join(placed.selectExpr("at", "of", "node AS subroot"), "at").selectExpr("of AS key", "steps", "subroot", "root")

    paths = descend(tiers, named, arity, height).withColumnRenamed("at", "chunk")
    return _chunked(nodes, arity, height).groupBy("key", "chunk").cogroup(paths.groupBy("key", "chunk")).applyInArrow(_fold_chunk(arity, height), FOLDED)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by language; where 7 divides the CRC-32 of the id, a change adds one to the number of characters."""
    def leaf(n_chars: Column) -> Column:
        return F.sha2(leaf_text(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")), 256)

    chars = F.col("n_chars").cast("decimal(20,0)")
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(chars).alias("leaf"), F.when(changed, leaf(chars + 1)).alias("replaced"))
