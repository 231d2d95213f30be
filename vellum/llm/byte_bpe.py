"""Byte-level BPE over a corpus: every distinct word is encoded once.

Texts are split into pre-tokens by the tokenizer's pattern. A block of rows keeps
the position lists of its texts as indices into its own distinct words, and sends
each distinct word to the bucket of its hash. A bucket encodes each distinct word
of the whole corpus once and answers the blocks; a block joins the ids back and
reassembles its texts by position. So a word that a third of all tokens repeat
crosses the shuffle once per block. Decoding looks the ids up in the table of
token bytes. The vocabulary has a fixed size and is broadcast.

Null texts are empty and give no tokens. Null ids, repeated rows and extra columns
change nothing: a block holds rows, not ids. Very long texts are split in steps,
so that only their index list is held. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 6 << 20
STEP = 1 << 17
#: Letters, numbers and white space below U+0100, for a faster pattern of the same meaning.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"

MAPPED = "key long, bucket int, block long, payload binary"
ANSWERS = "block long, bucket int, payload binary"
_STATE: dict = {}


def vocabulary(path: str) -> bytes:
    """The rank file; it is small, of fixed size and read by the driver."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer(ranks: bytes, pattern: str):
    """(encoder, bytes of each token), built once per worker."""
    key = (hash(ranks), pattern)
    if key not in _STATE:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _STATE.clear()
        _STATE[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), {v: k for k, v in table.items()}
    return _STATE[key]


def splitter(pattern: str):
    """Function from a text to its pre-tokens in order."""
    import regex

    general, fast = regex.compile(pattern), None
    if pattern == r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+":
        fast = re.compile(f"'(?:[sdmt]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

    def split(text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (m.group() for m in general.finditer(text))
        return (m.group() for m in (fast or general).finditer(text)) if len(text) > STEP else iter((fast or general).findall(text))

    return split


def _squeeze(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def _expand(payload: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    body = zstandard.ZstdDecompressor().decompress(payload)
    sizes = np.frombuffer(body, np.int64, len(kinds), 8)
    at, out = 8 * (1 + len(kinds)), []
    for kind, n in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return out, body[at:]


def explode(pattern: str, buckets: int):
    """Map side: per block one row of positions and one row of distinct words for each bucket."""
    def block_rows(block: int, ids: list, lengths: array, positions: array, words: dict):
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        given = np.array([x is not None for x in ids], np.uint8)
        known = np.array([x or 0 for x in ids], np.int64)
        rows = [(block, -1, block, _squeeze(given, known, np.array(lengths, np.uint64), place[np.array(positions, np.uint32)]))]
        named = list(words)
        edges = np.append(np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])), len(order)) if len(order) else []
        for a, b in zip(edges[:-1], edges[1:]):
            encoded = [named[k].encode() for k in order[a:b].tolist()]
            n = int(bucket[order[a]])
            rows.append((-1 - n, n, block, _squeeze(np.array([len(w) for w in encoded], np.uint32), tail=b"".join(encoded))))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["key", "bucket", "block", "payload"])

    def run(batches):
        split, base = splitter(pattern), TaskContext.get().partitionId() << 32

        def fresh():
            return [], array("Q"), array("I"), defaultdict(count().__next__)

        ids, lengths, positions, words = fresh()
        size = 0
        for batch in batches:
            numbers = batch["id"].to_pylist()
            for k, text in enumerate(batch["text"]):
                text = text.as_py()
                before, tokens = len(positions), split(text)
                while step := list(islice(tokens, STEP)):
                    positions.extend(map(words.__getitem__, step))
                ids.append(numbers[k])
                lengths.append(len(positions) - before)
                size += len(text) + 64
                if size >= BLOCK_CHARS:
                    yield block_rows(base, ids, lengths, positions, words)
                    base, size = base + 1, 0
                    ids, lengths, positions, words = fresh()
        if ids:
            yield block_rows(base, ids, lengths, positions, words)

    return run


def encode_words(ranks, pattern: str):
    """Reduce side: encode each distinct word of a bucket once, and answer every block that asked."""
    def run(batches):
        encoder, _ = tokenizer(ranks.value, pattern)
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, block, payload in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["payload"]):
                if bucket < 0:
                    continue
                if bucket != now:
                    now, known = bucket, {}
                (sizes,), raw = _expand(payload.as_py(), [np.uint32])
                ends = np.cumsum(sizes).tolist()
                ids = []
                for a, b in zip([0, *ends], ends):
                    word = raw[a:b]
                    if (code := known.get(word)) is None:
                        code = known[word] = encoder._core_bpe.encode_single_piece(word)
                    ids.append(code)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((x for code in ids for x in code), np.uint32, int(lengths.sum()))
                out.append((block, bucket, _squeeze(lengths, flat)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["block", "bucket", "payload"])

    return run


ENCODED = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _blank(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]).empty_table()


def reassemble(ranks, pattern: str, with_ids: bool):
    """Join the ids of a block's words back to its positions; decode them by the token-byte table."""
    schema = ENCODED + ", ids binary, decoded binary" if with_ids else ENCODED

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        empty = _blank(schema)
        own = [p.as_py() for b, p in zip(asked["bucket"].to_pylist(), asked["payload"]) if b < 0]
        if not own:
            return empty
        _, token_bytes = tokenizer(ranks.value, pattern)
        (given, known, lengths, positions), _ = _expand(own[0], [np.uint8, np.int64, np.uint64, np.uint32])
        sizes, names, spelt = [], [], []
        for _, payload in sorted(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist())):
            (n, flat), _ = _expand(payload, [np.uint32, np.uint32])
            at, codes = 0, flat.tolist()
            for k in n.tolist():
                code = codes[at : at + k]
                at += k
                sizes.append(k)
                names.append(" ".join(map(str, code)).encode())
                spelt.append(b"".join([token_bytes[x] for x in code]))
        sizes = np.array(sizes, np.int64)
        rows, at = [], 0
        for ok, key, n in zip(given.tolist(), known.tolist(), lengths.tolist()):
            part = positions[at : at + n]
            at += n
            listed = part.tolist()
            ids, decoded = b" ".join([names[k] for k in listed]), b"".join([spelt[k] for k in listed])
            row = (key if ok else None, int(sizes[part].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
            rows.append((*row, ids, decoded) if with_ids else row)
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), empty.schema.types)], schema=empty.schema)

    return run, schema


def encode_and_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row; ``ids`` are decimal, joined by spaces."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // (16 << 20))
    buckets = 16 + int((n_bytes / 2**20) ** 0.75)  # distinct words grow more slowly than texts
    dealt = rows.mapInArrow(explode(pattern, buckets), MAPPED).repartition(parts, "key").sortWithinPartitions("key")
    answers = dealt.mapInArrow(encode_words(ranks, pattern), ANSWERS)
    assemble, schema = reassemble(ranks, pattern, with_ids)
    return dealt.groupBy("key").cogroup(answers.groupBy("block")).applyInArrow(assemble, schema)
