"""Line deduplication and decontamination against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import decontamination as D
from vellum.llm.components import components
from vellum.llm.line_dedup import delete_repeated_runs


def brute_lines(rows, size, words=5):
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        worded = [k for k, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for k in range(len(worded) - size + 1):
            run = tuple(lines[j] for j in worded[k : k + size])
            if run in seen:
                gone.update(worded[k : k + size])
            seen.add(run)
        for k in worded:
            if len(lines[k].encode().split()) >= words:
                gone.update([k] if ("line", lines[k]) in seen else [])
                seen.add(("line", lines[k]))
        out[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_line_runs(spark, size):
    rng = random.Random(size)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " \t", f"u{k}", "dd", "e"]) for _ in range(rng.randrange(14)))) for k in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "x\n" * 9), (53, "")]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows] + [(60, None, 1, "z")], "doc_id long, text string, seq int, gone string").repartition(4)
    got = {r["row"]["doc_id"]: r for r in delete_repeated_runs(df, size).collect()}
    want = brute_lines(rows, size)
    assert {k: r["kept"] for k, r in got.items()} == {**want, 60: None}
    assert all(r["n_removed"] == len(dict(rows)[k].split("\n")) - len(want[k].split("\n")) for k, r in got.items() if k != 60 and want[k])
    assert got[3]["row"]["gone"] == "z"
    assert delete_repeated_runs(df.where("doc_id = 99"), size).count() == 0


@pytest.mark.parametrize("words", [1, 3, 5])
def test_long_lines_are_runs_by_themselves(spark, words):
    rng = random.Random(words)
    lines = [" ".join(rng.choice(["a", "b\x0b", "c\x1cd", "\u00a0"]) for _ in range(n)) for n in (1, 2, 2, 3, 4, 5, 6, 9)] + ["", "  five words \t with  blanks ", "x" * 99]
    rows = [(k, "\n".join(x for j in range(rng.randrange(6)) for x in (rng.choice(lines), f"own {k} {j}"))) for k in range(40)]
    rows += [(50, lines[7]), (51, lines[7]), (52, "\n".join([lines[6]] * 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["row"]["doc_id"]: r["kept"] for r in delete_repeated_runs(df, min_words=words).collect()}
    assert got == brute_lines(rows, 2, words) and got[51] == ""


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 2 + [(2, "a\nb\nd")], "doc_id long, text string")
    assert sorted((r["row"]["doc_id"], r["kept"]) for r in delete_repeated_runs(df, 2).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]


def distance_within(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def alone(item, text):
    """Whether a short item stands in the text with no letter or digit of the same word at its ends."""
    def one_word(a, b):
        return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"

    ends = [k for k in range(len(text)) if text.startswith(item, k)]
    return any((k == 0 or not one_word(text[k - 1], item[0])) and (k + len(item) == len(text) or not one_word(item[-1], text[k + len(item)])) for k in ends)


def test_short_items_of_scripts_without_blanks(spark):
    docs = spark.createDataFrame([(1, "前文今日は良い天気ですね後文"), (2, "catalogue"), (3, "the Cat, sat"), (4, "今日")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "今日は良い天気ですね"), (None, "cat"), (8, "")], "item_id long, text string")
    got = {r["id"]: [(x["item_id"], x["distance"], x["stop"]) for x in r["leaks"]] for r in D.find_leaks(docs, bench).collect()}
    assert got == {1: [(7, 0, 12)], 2: [], 3: [(None, 0, 7)], 4: []}


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    words = ["tha", "onan", "er", "ble", "ing", "Straße", "ou", "x"]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(n))

    items = [(k, prose(rng.randrange(12, 40))) for k in range(12)] + [(90, None), (91, "short"), (92, ""), (None, prose(14)), (None, "x ble"), (93, " "), (94, "THA"), (95, "ßeou x ing tha"), (96, "x")]
    items += [(100 + n, "x " * (n // 2) + "x" * (n % 2)) for n in range(1, 24)]
    rows = [(200, None), (201, "")]
    for k in range(90):
        text, planted = prose(60), list(items[k % 12][1])
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(planted))
            planted[at : at + rng.randrange(2)] = rng.choice(["q", "", "er"])
        cut = rng.randrange(len(text))
        rows.append((k, text[:cut] + "".join(planted).upper() + text[cut:]))
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, leaks string").repartition(3)
    benchmark = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, n int")
    got = {r["id"]: {(x["item_id"], x["distance"]) for x in r["leaks"]} for r in D.find_leaks(docs, benchmark).collect()}
    some = 0
    for key, text in rows:
        want = set()
        for item, said in items:
            said = D.normal(said)
            if len(said) >= 24:
                d = distance_within(said, D.normal(text))
                if d <= int(D.BUDGET * len(said)):
                    want.add((item, d))
            elif said and alone(said, D.normal(text)):
                want.add((item, 0))
        assert got[key] == want, key
        some += bool(want)
    assert 20 < some < 91
    assert sorted(r["doc_id"] for r in D.drop_leaky(docs, benchmark).collect()) == sorted(k for k in got if not got[k])
    assert D.find_leaks(docs, benchmark.where("item_id = 90")).where(F.size("leaks") > 0).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "zero " * 3 + "the quick brown fox jumps over it"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(k, "The quick  brown fox jumps ove" + "r" * (k % 2)) for k in range(5)], "item_id long, text string")
    whole = {r["id"]: r["leaks"] for r in D.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    assert {r["id"]: r["leaks"] for r in D.find_leaks(docs, bench).collect()} == whole
    assert len(whole[1]) == 5 and whole[2] == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
