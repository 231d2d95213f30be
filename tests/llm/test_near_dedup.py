"""BagMinHash against exact weighted Jaccard, and classes against brute force over all pairs."""

import random

import numpy as np

from vellum.llm import near_dedup
from vellum.llm.near_dedup import REGISTERS, common_counts, keep_one, multiset, near_duplicates, signatures, similarity


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    for weights in (1, 3, 40):
        agree, exact = [], []
        for _ in range(60):
            hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
            a, b = rng.integers(1, weights + 1, 60), rng.integers(1, weights + 1, 60)
            a[:8], b[-8:] = 0, 0
            bags = [(hashes[a > 0], a[a > 0]), (hashes[b > 0], b[b > 0])]
            signed = signatures(np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), np.repeat([0, 1], [len(x[0]) for x in bags]), 2)
            assert signed.shape == (2, REGISTERS) and np.isfinite(signed).all()
            agree.append((signed[0] == signed[1]).mean())
            exact.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        # 60 x 96 registers: a standard error of about 0.0065
        assert abs(np.mean(agree) - np.mean(exact)) < 0.025, (weights, np.mean(agree), np.mean(exact))


def test_large_weights_are_cheap_and_exact_copies_agree():
    hashes, weights = np.arange(3, dtype=np.uint64) + np.uint64(9), np.array([1, 10**6, 7])
    signed = signatures(np.tile(hashes, 2), np.tile(weights, 2), np.repeat([0, 1], 3), 2)
    assert (signed[0] == signed[1]).all()


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randrange(60, 160))]
        rows.append(text)
        for _ in range(rng.choice([0, 1, 3, 40 if base == 3 else 2])):
            copy = list(text)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [rows[0], rows[5], ["one", "two"], ["one", "two"], ["one"], ["la"] * 50, ["la"] * 60, ["la"] * 64]
    texts = [rng.choice([" ", "\n"]).join(r) for r in rows] + ["", " ", None, None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[n]) for k, n in enumerate(order)]


def brute(rows):
    bags = {k: multiset((t or "").encode().split()) for k, t in rows}
    parent = {k: k for k in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and similarity(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in bags}


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id long, text string, class string, n_links int").repartition(5)
    got = {r["id"]: r["class_row"] for r in near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    kept = keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and kept[0]["class"] == "x"


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, None), (2, None), (2, "x y")], "doc_id long, text string")
    got = sorted((r["id"] or 0, r["class_row"]) for r in near_duplicates(df).collect())
    own = {c for k, c in got if k == 0}  # the two null ids are classes apart, and the copies of the first one are in its class
    shared = {c for k, c in got if k == 1}
    assert [k for k, _ in got] == [0, 0, 1, 1, 1, 2, 2] and len(own) == 2 and len(shared) == 1 and shared < own and max(own) < -(2**62)
    assert [c for k, c in got if k == 2] == [2, 2]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in keep_one(df).collect()) == [(0, ""), (0, "a b c d e f"), (2, ""), (2, "x y")]
    assert near_duplicates(df.where("doc_id = 9")).count() == 0 and keep_one(df.where("doc_id = 9")).count() == 0


def test_blocks_compare_exactly():
    rng = np.random.default_rng(5)
    bags = []
    for _ in range(20):
        hashes = np.unique(rng.integers(0, 40, 25)).astype(np.uint64)
        bags.append((hashes, rng.integers(1, 5, len(hashes))))
    left, right = np.arange(0, 9), np.arange(5, 20)
    want = [[np.minimum(dict(zip(*map(np.ndarray.tolist, bags[a]))).get(h, 0), n) for h, n in zip(*map(np.ndarray.tolist, bags[b]))] for a in left for b in right]
    assert common_counts(bags, left, right).ravel().tolist() == [sum(x) for x in want]


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    """With every bucket large and blocks of seven, classes stay the same."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = corpus()
    got = {r["id"]: r["class_row"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_small_buckets_confirm_every_pair_of_two_components():
    """Registers that disagree by chance rule no pair out before the exact check."""
    import pyarrow as pa

    name = lambda k: {"row_id": k, "row_hash": 0}
    rows = [{"bucket": b, "node": name(k), "component": name(c), "sketch": bytes([k]) * REGISTERS} for b, k, c in [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 3, 3), (2, 4, 4)]]
    found = [tuple(x["row_id"] for x in p.values()) for b in near_dedup.compare_small([pa.RecordBatch.from_pylist(rows)]) for p in b.to_pylist()]
    assert sorted(found) == [(1, 3), (2, 3), (3, 4)]
