"""Exact deduplication against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from vellum.llm import minimisers as M
from vellum.llm.substring_dedup import remove_repeated_windows
from vellum.llm.suffix_dedup import remove_later_copies

SCHEMA = "doc_id long, text string, row_id string, spans int, n_words int"


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["der", "née", "x", "alpha", "of", "ß", "word", "on"]
    passage = [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(60)]
    out = []
    for n in range(60):
        words = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(rng.randrange(90))]
        if n % 3 == 0:
            cut = rng.randrange(20)
            words[5:5] = passage[cut : cut + 40]
        if n % 7 == 0 and out:
            words = out[rng.randrange(len(out))].split()
            words[rng.randrange(len(words) + 1) : 0] = ["odd"]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "  "]) for w in words))
    out += ["", " \n", "a" * 450, "ab" * 300, ("la " * 90), passage and " ".join(passage * 3)]
    return out


def brute_words(rows, length):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
    result = {}
    for i, w in words.items():
        gone = {k + d for k in range(len(w) - length + 1) if seen[tuple(w[k : k + length])] > 1 for d in range(length)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        result[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return result


def brute_bytes(rows, length):
    seen, result = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = set()
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                gone.update(range(k, k + length))
            seen.add(part)
        spans = sum(k - 1 not in gone for k in gone)
        result[i] = (len(raw), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest())
    return result


@pytest.mark.parametrize("length", [35, 9])
def test_word_windows(spark, length):
    rows = list(enumerate(texts(length)))
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows] + [(1000, None, None, None, None)], SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:4] for r in remove_repeated_windows(df, length).collect()}
    assert got == brute_words([*rows, (1000, None)], length)


@pytest.mark.parametrize("length", [100, 24])
def test_byte_strings(spark, length):
    rows = list(enumerate(texts(length + 1)))
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows] + [(1000, None, None, None, None)], SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:5] for r in remove_later_copies(df, length).collect()}
    assert got == brute_bytes([*rows, (1000, None)], length)


def test_small_pieces(spark, monkeypatch):
    """Long texts are packed in parts, batches are small, and all buckets are tiny."""
    monkeypatch.setattr(M, "PIECE", 256)
    rows = list(enumerate(texts(5)))
    units = M.Words(9)
    whole = [(i, part, windows) for i, t in rows for _, part, windows in units.pieces(t)]
    assert len({i for i, _, _ in whole}) < len(whole)
    assert sum(w for _, _, w in whole) == sum(max(0, len(t.encode().split()) - 8) for _, t in rows)
    assert sum(w for _, t in rows for _, _, w in M.Bytes(30).pieces(t)) == sum(max(0, len(t.encode()) - 29) for _, t in rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, None), (None, text + " x")], "doc_id long, text string")
    words = sorted((r[0] or 0, r[1], r[2]) for r in remove_repeated_windows(df).collect())
    assert words == [(0, 0, 0), (0, 51, 50), (1, 50, 50), (1, 50, 50)]
    kept = sorted((r[0] or 0, r[2]) for r in remove_later_copies(df).collect())
    assert kept == [(0, 0), (0, 0), (1, len(text)), (1, len(text))]  # the null id is the earliest
    empty = df.where("doc_id = 5")
    assert remove_repeated_windows(empty).count() == remove_later_copies(empty).count() == 0


def test_null_ids_whose_texts_share_half_a_hash(spark):
    """Texts of null ids are told apart by more than 32 bits."""
    made = spark.range(150_000).selectExpr("id", "concat(array_join(transform(sequence(1, 45 + cast(id % 9 as int)), x -> concat('v', x)), ' '), ' ', id) AS text")
    close = made.selectExpr("id", "text", "xxhash64(text) & 4294967295 AS half")
    pair = close.join(close.selectExpr("id AS other", "half"), "half").where("id <> other AND id % 9 <> other % 9").select("text").limit(2).collect()
    assert len(pair) == 2
    rows = [(None, r["text"]) for r in pair] + [(None, " ".join(f"v{k}" for k in range(1, 40))), (None, "v1 v2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = list(enumerate(t for _, t in rows))
    assert sorted(tuple(r)[1:4] for r in remove_repeated_windows(df).collect()) == sorted(brute_words(named, 35).values())
    kept = sorted((r["n_bytes"], r["n_removed"]) for r in remove_later_copies(df).collect())
    assert [n for n, _ in kept] == sorted(len(t) for _, t in rows) and sum(n > 0 for _, n in kept) == 2  # all but the first of the three


def test_many_equal_rows(spark):
    """A key that a great many rows share costs as many spans as one of its texts has."""
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.range(30_000).selectExpr("5L AS doc_id", f"'{text}' AS text").unionAll(spark.createDataFrame([(6, "w1 w2")], "doc_id long, text string"))
    counts = remove_repeated_windows(df).groupBy("id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, counts)) == [(5, 80, 80, 30_000), (6, 2, 0, 1)]
    counts = remove_later_copies(df).groupBy("id", "n_removed").count().collect()
    assert sorted(map(tuple, counts)) == [(5, 0, 30_000), (6, 0, 1)]
