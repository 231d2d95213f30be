"""Dealing fixed-length windows to buckets by minimisers, as packed segments.

Every window of ``length`` units has a minimiser: the least hash of its grams.
Consecutive windows with one minimiser share nearly all their units, so they
travel together as one segment, from the first unit of the first window to the
last unit of the last. Equal windows have equal minimisers and meet in one
bucket. The number of buckets follows the bytes of the input, so a bucket is of
constant size at any scale.

Hot grams (those of a line or passage that a good part of all documents share)
are ranked behind all others, so that a window takes one of them only if it has
no other. They are found in a sample of rows, which decides where windows go but
not what is found. Segments that are equal within a batch are merged before the
shuffle, so a passage shared by any number of rows is sent once per batch.

Units are bytes or words. Words are separated by single spaces in the buffers.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

PIECE = 1 << 21
BUCKET_BYTES = 4 << 20
SAMPLE_ROWS = 2000
HOT_SHARE = 1 / 250
MOST_HOT = 1 << 16
TOP = np.uint64(1 << 63)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _POWERS[base] = tuple(tables)
    return _POWERS[base]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one running sum."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Bytes:
    """Windows over the bytes of a text."""

    def __init__(self, length: int = 100, gram: int = 12):
        self.length, self.gram = length, gram

    def pieces(self, text: str):
        """(first unit, bytes, windows) of bounded parts that overlap by a window less one unit."""
        raw = text.encode()
        for at in range(0, len(raw) - self.length + 1, PIECE):
            part = raw[at : at + PIECE + self.length - 1]
            yield at, part, len(part) - self.length + 1

    def units(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every unit in a buffer."""
        at = np.arange(len(buffer), dtype=np.int64)
        return at, at + 1

    def grams(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.frombuffer(buffer + bytes(8), np.uint8)
        words = np.ndarray((len(buffer),), "<u8", padded, strides=(1,)).copy()
        n = max(0, len(buffer) - self.gram + 1)
        return mix(words[:n] * np.uint64(_P) + words[self.gram - 8 : self.gram - 8 + n] * np.uint64(_Q))

    def window_hash(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        return range_hash(np.frombuffer(buffer, np.uint8).astype(np.uint64), at, at + self.length, _P)


class Words(Bytes):
    """Windows over the words of a text; a word is anything between ASCII white space."""

    def __init__(self, length: int = 35, gram: int = 4):
        super().__init__(length, gram)

    def pieces(self, text: str):
        words = text.encode().split()
        for at in range(0, len(words) - self.length + 1, PIECE // 8):
            part = words[at : at + PIECE // 8 + self.length - 1]
            yield at, b" ".join(part), len(part) - self.length + 1

    def units(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        return np.append(0, gaps + 1), np.append(gaps, len(buffer))

    def word_hash(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return range_hash(np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends, _P)

    def grams(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        words = self.word_hash(buffer, starts, ends)
        at = np.arange(max(0, len(words) - self.gram + 1))
        return range_hash(words, at, at + self.gram, _Q)

    def window_hash(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        return range_hash(self.word_hash(buffer, starts, ends), at, at + self.length, _Q)


def batches(arrow_batches, units: Bytes):
    """Pieces of the rows' texts, gathered to about PIECE bytes: lists of (row_id, row_hash, first unit, bytes, windows)."""
    held, size = [], 0
    for batch in arrow_batches:
        ids, hashes = batch["row_id"].to_pylist(), batch["row_hash"].to_pylist()
        for k, text in enumerate(batch["text"]):
            for at, part, windows in units.pieces(text.as_py()):
                held.append((ids[k], hashes[k], at, part, windows))
                size += len(part)
                if size >= PIECE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def segments(held: list, units: Bytes, hot: np.ndarray):
    """(buffer, begin, end, units, piece, offset, minimiser) of the segments of one batch."""
    buffer = b" ".join(x[3] for x in held)
    starts, ends = units.units(buffer)
    sizes = np.array([len(x[3]) for x in held], np.int64)
    offsets = np.append(0, np.cumsum(sizes + 1)[:-1])
    first = np.searchsorted(starts, offsets)
    grams = units.grams(buffer, starts, ends)
    if len(hot):
        grams = demoted(grams, hot)
    best = sliding_min(grams, units.length - units.gram + 1)
    windows = np.array([x[4] for x in held], np.int64)
    edge = np.zeros(len(best) + 2, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8)[: len(best) + 1].astype(bool)
    valid[len(best)] = False
    opens = valid[:-1].copy()
    opens[1:] &= (best[1:] != best[:-1]) | ~valid[:-2]
    opens[first] = True
    begin = np.flatnonzero(opens)
    closes = valid[:-1] & np.append(opens[1:], True)
    closes |= valid[:-1] & ~valid[1:]
    last = np.flatnonzero(closes)
    piece = np.searchsorted(first, begin, "right") - 1
    return buffer, starts[begin], ends[last + units.length - 1], last - begin + units.length, piece, begin - first[piece], best[begin]


def demoted(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Clear the top bit, then set it for hot grams; a small bit table rules out nearly all others first."""
    grams &= ~TOP
    table = np.zeros(1 << 16, bool)
    table[(hot >> np.uint64(47)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(grams >> np.uint64(47)).astype(np.int64)])
    found = np.minimum(np.searchsorted(hot, grams[maybe]), len(hot) - 1)
    grams[maybe[hot[found] == grams[maybe]]] |= TOP
    return grams


def hot_grams(rows, n_rows: int, units: Bytes) -> np.ndarray:
    """The grams that more than HOT_SHARE of about SAMPLE_ROWS rows hold, at most MOST_HOT of them."""
    from pyspark.sql import functions as F

    share = min(1.0, SAMPLE_ROWS / max(1, n_rows))
    sample = rows.where(F.pmod(F.xxhash64("row_id", "row_hash"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(arrow_batches):
        for held in batches(arrow_batches, units):
            buffer = b" ".join(x[3] for x in held)
            grams, n = np.unique(units.grams(buffer, *units.units(buffer)) & ~TOP, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

    counted = sample.select("row_id", "row_hash", "text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(4, int(HOT_SHARE * share * n_rows))
    found = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(MOST_HOT).toArrow()["gram"].to_numpy()
    return np.sort(found.view(np.uint64))


class Codec:
    """Compression of what the shuffle carries, with a few sample texts as its dictionary: payloads are short."""

    def __init__(self, rows):
        from pyspark.sql import functions as F

        shown = rows.select(F.substring("text", 1, 3000).alias("text")).limit(SHOWN_ROWS).collect()
        self.shown = "".join(r["text"] for r in shown).encode()

    def tools(self):
        if self.shown not in _CODECS:
            _CODECS.clear()
            shared = zstandard.ZstdCompressionDict(self.shown, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(self.shown) > 8 else None
            _CODECS[self.shown] = zstandard.ZstdCompressor(level=3, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)
        return _CODECS[self.shown]

    def squeeze(self, raw: bytes) -> bytes:
        return self.tools()[0].compress(raw)

    def expand(self, packed: bytes) -> bytes:
        return self.tools()[1].decompress(packed)


SHOWN_ROWS = 32
_CODECS: dict = {}
SCHEMA = "bucket long, payload binary"
#: Columns of a payload: units of each segment, row id, row hash, first unit.
KINDS = ["<u4", "<i8", "<i8", "<u4"]
_HEAD = struct.Struct("<qq")


def packed(codec: Codec, bucket: int, raw: bytes, *columns: np.ndarray) -> tuple[int, bytes]:
    """One row: the columns of its segments and their units, compressed."""
    body = b"".join(c.astype(kind).tobytes() for c, kind in zip(columns, KINDS))
    return bucket, codec.squeeze(_HEAD.pack(len(columns[0]), len(raw)) + body + raw)


def unpacked(codec: Codec, payload: bytes) -> tuple[list[np.ndarray], bytes]:
    body = codec.expand(payload)
    n, size = _HEAD.unpack_from(body)
    at, columns = _HEAD.size, []
    for kind in KINDS:
        columns.append(np.frombuffer(body, kind, n, at))
        at += columns[-1].nbytes
    return columns, body[len(body) - size :]


def by_bucket(arrow_batches):
    """(bucket, payloads) of a partition that is sorted by bucket."""
    bucket, payloads = None, []
    for batch in arrow_batches:
        for b, payload in zip(batch["bucket"].to_pylist(), batch["payload"]):
            if b != bucket and payloads:
                yield bucket, payloads
                payloads = []
            bucket = b
            payloads.append(payload.as_py())
    if payloads:
        yield bucket, payloads


SPANS = "row_id long, row_hash long, start long, stop long"


def span_batch(row_id, row_hash, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x, np.int64)) for x in (row_id, row_hash, start, stop)], ["row_id", "row_hash", "start", "stop"])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    step = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
