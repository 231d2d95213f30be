"""Removal of later copies of byte strings: positions whose longest previous factor is long enough.

The longest previous factor of a position is the longest string that starts there
and also at an earlier position (a smaller id, or the same document further
left). Where it reaches 100 bytes, those 100 bytes are removed; the first copy
stays. Texts are judged as they came, so removals do not influence each other.

The factors themselves are not computed. One reaches 100 bytes just where the
window of 100 bytes also stands at an earlier place, so positions whose 100 bytes
are equal meet in one bucket by their minimiser, are grouped by a hash that is
confirmed on the bytes, and all but the least place of a group are marked.

Null texts are empty. Texts below the length have no window. Rows that repeat an
id and a text are one document: they are no earlier copies of each other. Of
different texts of one id the order is that of a hash of the text. Very long
texts are packed in parts that overlap by 99 bytes. Columns beyond id and text
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import minimisers as M
from vellum.llm.rows import KEY, keyed
from vellum.llm.substring_dedup import apply_spans



def pack(units: M.Bytes, hot: np.ndarray, buckets: int, codec: M.Codec):
    """Map side: segments of each batch. Of equal segments only the earliest is sent; the others are later copies."""
    def run(arrow_batches):
        for held in M.batches(arrow_batches, units):
            buffer, begin, end, size, piece, offset, best = M.segments(held, units, hot)
            strings = [buffer[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            row_id = np.array([x[0] for x in held], np.int64)[piece]
            row_hash = np.array([x[1] for x in held], np.int64)[piece]
            start = np.array([x[2] for x in held], np.int64)[piece] + offset
            order = np.lexsort((start, row_hash, row_id))
            first: dict[bytes, int] = {}
            leader = np.fromiter((first.setdefault(strings[k], k) for k in order.tolist()), np.int64, len(order))
            same = np.empty(len(order), np.int64)
            same[order] = leader
            later = same != np.arange(len(same))
            rows = []
            if later.any():
                gone = np.flatnonzero(later & ~((row_id == row_id[same]) & (row_hash == row_hash[same]) & (start == start[same])))
                rows.append(M.packed(codec, -1 - (int(begin[0]) + len(buffer)) % 997, b"", size[gone], row_id[gone], row_hash[gone], start[gone]))
            sent = np.flatnonzero(~later)
            key = (best[sent] % np.uint64(buckets)).astype(np.int64)
            by_key = np.argsort(key, kind="stable")
            sent, key = sent[by_key], key[by_key]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for a, b in zip(edges[:-1], edges[1:]):
                at = sent[a:b]
                rows.append(M.packed(codec, int(key[a]), b"".join([strings[k] for k in at.tolist()]), size[at], row_id[at], row_hash[at], start[at]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])
    return run


def suffix_ranks(buffer: bytes, at: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` bytes; equal strings share a rank.

    Only one suffix of each group of equal ones is sorted. Groups come from the
    hashes and are confirmed byte by byte.
    """
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
    a, b = at[order[1:][~new[1:]]], at[order[:-1][~new[1:]]]
    words = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,)) if length >= 8 else None
    equal = np.ones(len(a), bool)
    if words is None:
        equal = np.array([buffer[p : p + length] == buffer[q : q + length] for p, q in zip(a.tolist(), b.tolist())], bool)
    else:
        for k in [*range(0, length - 7, 8), length - 8]:
            equal &= words[a + k] == words[b + k]
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(buffer, np.uint8), length)
    if not equal.all():  # different strings of one hash: sort all of them
        every = np.ascontiguousarray(strings[at]).view(f"V{length}").ravel()
        places: dict[bytes, int] = {v: k for k, v in enumerate(sorted(set(map(bytes, every))))}
        return np.array([places[bytes(v)] for v in every], np.int64)
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    shown = at[order[new]]
    rank = np.empty(len(shown), np.int64)
    rank[np.argsort(np.ascontiguousarray(strings[shown]).view(f"S{length}").ravel(), kind="stable")] = np.arange(len(shown))
    return rank[group]


def has_previous_factor(buffer: bytes, at: np.ndarray, place: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches ``length``; ``place`` is its position among all texts."""
    ranked = np.sort(hashes)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    found = np.zeros(len(at), bool)
    if not len(twice):
        return found
    spot = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    chosen = np.flatnonzero(twice[spot] == hashes)
    rank = suffix_ranks(buffer, at[chosen], hashes[chosen], length)
    order = np.lexsort((place[chosen], rank))
    rank, places = rank[order], place[chosen][order]
    # Suffix order with ties by position: inside a run of equal prefixes places do not fall, so the previous
    # smaller position of a suffix is the start of the last step up before it, and the next smaller one lies
    # beyond the run, where the common prefix is shorter. Suffixes at one place (repeated rows) tie.
    run_start = np.append(True, rank[1:] != rank[:-1])
    first = places[np.maximum.accumulate(np.where(run_start, np.arange(len(rank)), 0))]
    found[chosen[order[places > first]]] = True
    return found


def factor(units: M.Bytes, codec: M.Codec):
    """Reduce side: spans of the positions whose longest previous factor is long enough."""
    def run(arrow_batches):
        for bucket, payloads in M.by_bucket(arrow_batches):
            parts = [M.unpacked(codec, p) for p in payloads]
            if bucket < 0:
                for (size, row_id, row_hash, start), _ in parts:
                    yield M.span_batch(row_id, row_hash, start, start.astype(np.int64) + size)
                continue
            size, row_id, row_hash, start = (np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k in range(4))
            buffer = b"".join(p[1] for p in parts)
            del parts
            first = np.append(0, np.cumsum(size)[:-1])
            windows = size - units.length + 1
            owner = np.repeat(np.arange(len(size)), windows)
            at = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(windows)[:-1]) - first, windows)
            order = np.lexsort((row_hash, row_id))
            new = np.append(True, (row_id[order[1:]] != row_id[order[:-1]]) | (row_hash[order[1:]] != row_hash[order[:-1]]))
            document = np.empty(len(order), np.int64)
            document[order] = np.cumsum(new)
            place = (document << 32)[owner] + (start - first)[owner] + at
            hashes = units.window_hash(buffer, None, None, at)
            found = has_previous_factor(buffer, at, place, hashes, units.length)
            flags = np.zeros(len(buffer) + 1, bool)
            flags[at[found]] = True
            a, b = M.runs(flags)  # the last bytes of a segment start no window, so a run ends with its segment
            own = np.searchsorted(first, a, "right") - 1
            yield M.span_batch(row_id[own], row_hash[own], start[own] + a - first[own], start[own] + b - first[own] + units.length)
    return run


def later_copies(rows: DataFrame, units: M.Bytes, n_rows: int, n_bytes: int, codec: M.Codec) -> DataFrame:
    """Spans (in bytes) of every row of ``keyed`` rows that earlier text repeats; they may overlap."""
    buckets = max(16, -(-4 * n_bytes // M.BUCKET_BYTES))
    hot = M.hot_grams(rows, n_rows, units)
    sent = rows.select(*KEY, "text").mapInArrow(pack(units, hot, buckets, codec), M.SCHEMA)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(factor(units, codec), M.SPANS)


def keep_bytes(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """(bytes, removed bytes, maximal removed runs, digest of the kept bytes, kept bytes)."""
    if not len(starts):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    order = np.argsort(starts)
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > reach[:-1])
    begins, ends = starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    kept = b"".join(raw[a:b] for a, b in zip(np.append(0, ends).tolist(), np.append(begins, len(raw)).tolist()))
    return len(raw), len(raw) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept


def remove_later_copies(docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per input row; ``kept`` may cut characters."""
    rows, units = keyed(docs, id_column, text_column), M.Bytes(length, min(12, length))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    codec = M.Codec(rows)
    spans = later_copies(rows, units, n_rows, n_bytes, codec)
    return apply_spans(rows, spans, codec, keep_bytes, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
