"""Secrets in texts: three fixed shapes, and strings that a tokenizer finds costly.

A byte-level BPE vocabulary has long tokens for what people write and only short ones
for random strings. A run of at least ``MIN_CHARS`` characters of ``RUN`` that costs a
token for every two characters or less (``MAX_RATIO``) is reported as ``dense``, unless
it is known not to be a secret:

* a digest: hex digits of one case, of the length of a usual hash, with or without the
  name of the hash in front (``sha256-``, ``md5=``);
* an identifier: UUIDs, numbers, dates and versions, and names, that is runs without
  digits, or whose parts between ``_ . / - = +`` are each a word, a number, or a short word with a short number;
* a run that a fixed shape has reported already, as a whole or in part.

Spans count code points. Null texts are empty; empty texts have no spans; repeated rows
and null ids are rows of their own; extra columns are ignored; an empty table gives no
rows. Texts are scanned whole, in one task each; a long run is tokenised in pieces
of ``PIECE`` characters, so its cost stays linear. No rows are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.byte_bpe import tokenizer, vocabulary

KINDS = ["assign", "access", "hex", "dense"]
_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ASSIGN_CHARS = 6
#: Without one of these in its bytes, A-Z lower-cased, a text has no assignment.
HINTS = [b"passw", b"secret", b"token", b"api"]
#: (kind, pattern): runs below the least length never match, which is the same as dropping them, since a run is matched as a whole.
SHAPES = [(1, re.compile(r"AKIA[A-Z0-9]{16,}")), (2, re.compile(r"[0-9a-f]{24,}"))]

MIN_CHARS = 20
#: Characters a token, at most.
MAX_RATIO = 2.0
PIECE = 256
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CHARS},}}")
DIGEST = re.compile(r"(?:(?:md5|sha\d*|sha\d-\d+)[-=])?(?:[0-9a-f]+|[0-9A-F]+)", re.ASCII)
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = r"[A-Za-z]?[a-z]+|[A-Z]+|\d+|[A-Za-z]{1,4}\d{1,4}"
NAME = re.compile(rf"(?:{_PART})?(?:[_./=+-]+(?:{_PART}|$))*")

SCANNED = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long"


def is_known(run: str) -> bool:
    """Digests and identifiers: costly in tokens, yet no secrets."""
    if DIGEST.fullmatch(run) and len(re.split(r"[-=]", run)[-1]) in DIGEST_CHARS:
        return True
    return not any("0" <= c <= "9" for c in run) or bool(UUID.fullmatch(run) or NAME.fullmatch(run))


def shaped(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes: leftmost non-overlapping matches of each, those too short dropped.

    Characters of the last two shapes are characters of ``RUN``, and both are as long, so they are looked for in its runs only.
    """
    lowered, found = text.encode("utf-8", "surrogatepass").lower(), []
    if any(hint in lowered for hint in HINTS):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    return found + [(m.start(), k, m.end()) for a, b in runs for k, pattern in SHAPES for m in pattern.finditer(text, a, b)]


def dense(text: str, runs: list[tuple[int, int]], taken: list[tuple[int, int, int]], n_tokens) -> list[tuple[int, int, int]]:
    """Runs that cost a token for ``MAX_RATIO`` characters or less, are not known, and share no character with a span of ``taken``."""
    spans, at, found = sorted((a, b) for a, _, b in taken), 0, []
    for start, end in runs:
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        # spans of different kinds may nest, so look past the first
        if any(a < end and b > start for a, b in _until(spans, at, end)):
            continue
        run = text[start:end]
        if end - start <= MAX_RATIO * n_tokens(run) and not is_known(run):
            found.append((start, KINDS.index("dense"), end))
    return found


def _until(spans: list, at: int, end: int):
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the fixed shapes, their digest, and all spans; ``pattern`` is the tokenizer's."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))  # a file of fixed size

    def run(batches):
        encoder, _ = tokenizer(ranks.value, pattern)

        @lru_cache(1 << 14)
        def counted(piece: str) -> int:
            return len(encoder.encode_ordinary(piece))

        def n_tokens(text: str) -> int:
            return sum(counted(text[k : k + PIECE]) for k in range(0, len(text), PIECE))

        for batch in batches:
            rows = []
            for number, text in zip(batch["id"].to_pylist(), batch["text"]):
                text = text.as_py()
                runs = [m.span() for m in RUN.finditer(text)]
                base = shaped(text, runs)
                more = dense(text, runs, base, n_tokens)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((number, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCANNED.split(", ")])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCANNED)
