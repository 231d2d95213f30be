"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window of 35 words whose words also start at any other place, in the same or in
another document, marks all its words for removal; all copies go. Windows that
share a minimiser travel as one packed string (a super-k-mer) to the minimiser's
bucket; there the windows are sorted by hash, and neighbours of one hash are
compared word for word, so counts are exact.

Null and empty texts and texts below 35 words have no window. Rows that repeat an
id and a text are further places of their windows. Very long texts are packed in
parts that overlap by 34 words. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import minimisers as M
from vellum.llm.rows import KEY, keyed

#: In place of a start: this copy stands for several, whose places are settled already.
MERGED = 0xFFFFFFFF


def pack(units: M.Words, hot: np.ndarray, buckets: int, codec: M.Codec):
    """Map side: super-k-mers of each batch, equal ones merged.

    Windows of merged super-k-mers are known to be repeated, so their places are
    settled here (bucket below zero); the one copy that is sent only counts.
    """
    def run(arrow_batches):
        for held in M.batches(arrow_batches, units):
            buffer, begin, end, n_words, piece, offset, best = M.segments(held, units, hot)
            strings = [buffer[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            first: dict[bytes, int] = {}
            same = np.fromiter((first.setdefault(s, k) for k, s in enumerate(strings)), np.int64, len(strings))
            copies = np.bincount(same, minlength=len(strings))
            row_id = np.array([x[0] for x in held], np.int64)[piece]
            row_hash = np.array([x[1] for x in held], np.int64)[piece]
            start = np.array([x[2] for x in held], np.int64)[piece] + offset
            again = copies[same] > 1
            rows = []
            if again.any():
                rows.append(M.packed(codec, -1 - (int(begin[0]) + len(buffer)) % 997, b"", n_words[again], row_id[again], row_hash[again], start[again]))
            sent = np.flatnonzero(same == np.arange(len(strings)))
            key = (best[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            sent, key = sent[order], key[order]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            many = copies > 1
            for a, b in zip(edges[:-1], edges[1:]):
                at = sent[a:b]
                raw = b" ".join([strings[k] for k in at.tolist()])
                rows.append(M.packed(codec, int(key[a]), raw, n_words[at], row_id[at], row_hash[at], np.where(many[at], MERGED, start[at])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])
    return run


def repeated(buffer: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more: sort by hash, then compare neighbours exactly."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    close = np.flatnonzero(ranked[1:] == ranked[:-1])
    found = weight > 1
    a, b = order[close], order[close + 1]
    left, right = zip(begin[a].tolist(), end[a].tolist()), zip(begin[b].tolist(), end[b].tolist())
    equal = np.fromiter((buffer[p:q] == buffer[r:s] for (p, q), (r, s) in zip(left, right)), bool, len(a))
    found[a[equal]] = True
    found[b[equal]] = True
    for value in np.unique(ranked[close[~equal]]):  # different windows of one hash
        places: dict[bytes, list[int]] = {}
        for k in order[np.searchsorted(ranked, value) : np.searchsorted(ranked, value, "right")].tolist():
            places.setdefault(buffer[begin[k] : end[k]], []).append(k)
        for group in places.values():
            if len(group) > 1:
                found[group] = True
    return found


def count(units: M.Words, codec: M.Codec):
    """Reduce side: the spans of repeated windows, bucket by bucket."""
    def run(arrow_batches):
        for bucket, payloads in M.by_bucket(arrow_batches):
            if bucket < 0:
                for payload in payloads:
                    (n_words, row_id, row_hash, start), _ = M.unpacked(codec, payload)
                    yield M.span_batch(row_id, row_hash, start, start.astype(np.int64) + n_words)
                continue
            parts = [M.unpacked(codec, p) for p in payloads]
            n_words, row_id, row_hash, start = (np.concatenate([p[0][k] for p in parts]).astype(np.int64) for k in range(4))
            buffer = b" ".join(p[1] for p in parts)
            del parts
            starts, ends = units.units(buffer)
            first = np.append(0, np.cumsum(n_words)[:-1])
            windows = n_words - units.length + 1
            owner = np.repeat(np.arange(len(n_words)), windows)
            at = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(windows)[:-1]) - first, windows)
            hashes = units.window_hash(buffer, starts, ends, at)
            merged = start == MERGED
            found = repeated(buffer, starts[at], ends[at + units.length - 1], hashes, np.where(merged, 2, 1)[owner]) & ~merged[owner]
            flags = np.zeros(len(starts) + 1, bool)
            flags[at[found]] = True
            a, b = M.runs(flags)  # the last words of a segment start no window, so a run ends with its segment
            own = np.searchsorted(first, a, "right") - 1
            yield M.span_batch(row_id[own], row_hash[own], start[own] + a - first[own], start[own] + b - first[own] + units.length)
    return run


def repeated_spans(rows: DataFrame, units: M.Words, n_rows: int, n_bytes: int, codec: M.Codec) -> DataFrame:
    """Spans (in words) of every row of ``keyed`` rows that windows found elsewhere cover; they may overlap."""
    buckets = max(16, -(-4 * n_bytes // M.BUCKET_BYTES))
    hot = M.hot_grams(rows, n_rows, units)
    sent = rows.select(*KEY, "text").mapInArrow(pack(units, hot, buckets, codec), M.SCHEMA)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count(units, codec), M.SPANS)


def apply_spans(rows: DataFrame, spans: DataFrame, codec: M.Codec, function, schema: str) -> DataFrame:
    """Join the spans to their rows and run ``function(raw, starts, stops) -> tuple`` on each row's UTF-8 bytes."""
    # Equal rows find equal spans: a set, merged before it is sent, is as long as one text needs.
    gathered = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    names = [x.split()[0] for x in schema.split(", ")]

    def squeeze(arrow_batches):
        for batch in arrow_batches:
            texts = pa.array([codec.squeeze(t.as_py().encode()) for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEY, "id")), texts], [*KEY, "id", "text"])

    def run(arrow_batches):
        for batch in arrow_batches:
            out = []
            for k, text in enumerate(batch["text"]):
                found = batch["spans"][k].values
                ends = (np.empty(0, np.int64),) * 2 if found is None else (found.field("start").to_numpy(), found.field("stop").to_numpy())
                out.append(function(codec.expand(text.as_py()), *ends))
            columns = list(zip(*out)) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, columns)], names) if out else pa.RecordBatch.from_pylist([], pa.schema([(names[0], pa.int64())]))

    small = rows.mapInArrow(squeeze, "row_id long, row_hash long, id long, text binary")
    return small.join(gathered, KEY, "left").select("id", "text", "spans").mapInArrow(run, schema)


def keep_words(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, str, str]:
    """(words, removed words, digest of the kept words, kept words)."""
    words = raw.split()
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = b" ".join(words[k] for k in np.flatnonzero(~gone).tolist()) if gone.any() else b" ".join(words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()


def remove_repeated_windows(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): one row per input row."""
    rows, units = keyed(docs, id_column, text_column), M.Words(length, min(4, length))
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    codec = M.Codec(rows)
    spans = repeated_spans(rows, units, n_rows, n_bytes, codec)
    return apply_spans(rows, spans, codec, keep_words, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
