"""Queries of the dataset manifest, secret scans and whitening, and SQL for the manifest.

SQL has no BPE and no eigenvectors; those two are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.bpe_queries import RANKS
from vellum.llm.merkle_manifest import ARITY, document_leaves, manifest
from vellum.llm.secret_scan import scan
from vellum.llm.whitening import whiten


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf('n_chars')} AS leaf,
           CASE WHEN xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 7 = 0
               THEN {_leaf('CAST(n_chars AS HUGEINT) + 1')} END AS replaced
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS total FROM leaves),
nodes(level, key, pos, total, node) AS (
    SELECT 0, key, pos, total, leaf FROM placed
    UNION ALL
    SELECT level + 1, key, pos // {ARITY}, (total + {ARITY - 1}) // {ARITY}, sha256(string_agg(node, '' ORDER BY pos))
    FROM nodes WHERE total > 1 GROUP BY level, key, pos // {ARITY}, total),
subroots AS (
    SELECT key, level AS height, node AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
upper_nodes(level, pos, total, node) AS (
    SELECT 0, pos, total, subroot FROM subroots
    UNION ALL
    SELECT level + 1, pos // {ARITY}, (total + {ARITY - 1}) // {ARITY}, sha256(string_agg(node, '' ORDER BY pos))
    FROM upper_nodes WHERE total > 1 GROUP BY level, pos // {ARITY}, total),
every AS (
    SELECT key, level, pos, node FROM nodes UNION ALL SELECT key, height + upper_nodes.level, upper_nodes.pos + 1000000000000, node FROM upper_nodes, subroots),
way AS (
    SELECT p.doc_id, p.key, p.pos AS leaf_pos, p.leaf, p.replaced, s.subroot, s.height, s.pos AS group_pos,
           s.height + (SELECT max(level) FROM upper_nodes) AS top FROM placed p JOIN subroots s USING (key)),
folds(key, leaf_pos, level, top, height, group_pos, own, folded, proof) AS (
    SELECT key, leaf_pos, 0, top, height, group_pos, CASE WHEN height > 0 THEN leaf_pos ELSE group_pos + 1000000000000 END, coalesce(replaced, leaf), '' FROM way
    UNION ALL
    SELECT f.key, f.leaf_pos, f.level + 1, f.top, f.height, f.group_pos,
           CASE WHEN f.level + 1 = f.height THEN f.group_pos + 1000000000000
                WHEN f.level + 1 > f.height THEN (f.own - 1000000000000) // {ARITY} + 1000000000000 ELSE f.own // {ARITY} END,
           sha256(CASE WHEN f.own % {ARITY} = 1 THEN e.node || f.folded ELSE f.folded || coalesce(e.node, '') END), f.proof || coalesce(e.node, '')
    FROM folds f LEFT JOIN every e ON e.key = f.key AND e.level = f.level AND e.pos = xor(f.own, 1)
    WHERE f.level < f.top)
SELECT w.doc_id, w.leaf, w.subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.node AS verified
FROM way w JOIN folds f ON f.key = w.key AND f.leaf_pos = w.leaf_pos AND f.level = w.top, (SELECT node FROM upper_nodes WHERE total = 1) r
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest, "op12_secret_scan": op12_secret_scan, "op13_embedding_whitening": op13_embedding_whitening}
ORACLES = {"op11_merkle_manifest": OP11_SQL}
