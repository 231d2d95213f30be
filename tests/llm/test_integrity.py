"""Manifest, secret scan and whitening against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from vellum.llm import merkle_manifest as M
from vellum.llm import secret_scan as S
from vellum.llm import whitening as W
from vellum.llm.integrity_queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Levels from the leaves to the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[k : k + arity]) for k in range(0, len(below), arity)])
    return levels


def plain_path(levels, at, arity):
    for nodes in levels[:-1]:
        first = at - at % arity
        yield nodes[first:at], nodes[at + 1 : first + arity]
        at //= arity


def plain_manifest(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars) rows."""
    def leaf(r, more=0):
        chars = r[4] if r[4] is None else r[4] + more
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], chars, r[1])))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    over = plain_tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = leaf(r, 1) if tampered else own, ""
            for before, after in [*plain_path(trees[g], at, arity), *plain_path(over, k, arity)]:
                proof += "".join(before) + "".join(after)
                folded = h(*before, folded, *after)
            out.append((r[0], own, trees[g][-1][0], over[-1][0], h(proof), folded, folded == over[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity,height", [(2, 12), (2, 2), (3, 2), (5, 1)])
def test_manifest(spark, arity, height):
    rows = [(k, f"text {k} é", ["en", "de", None, "Ünl", ""][k % 11 % 5], None if k % 9 == 0 else "src", None if k % 7 == 0 else k) for k in range(-9, 70)]
    rows += [(None, "x", "en", "s", 1), (None, None, None, None, None), (5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (900, "", "solo", "s", 2**63 - 1)]
    leaves = M.document_leaves(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, M.manifest(leaves, arity, height).collect()), key=repr) == plain_manifest(rows, arity)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "t", "en", "s", 1) for k in range(n)]
    assert sorted(map(tuple, M.manifest(M.document_leaves(spark.createDataFrame(rows, DOCS))).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*(x.split()[0] for x in DOCS.split(", ")))
    got = sorted(map(tuple, QUERIES["op11_merkle_manifest"](spark, folder).collect()), key=repr)
    assert got == plain_manifest([tuple(r) for r in docs.collect()])
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_fold_uses_no_left_sibling():
    tree = M.Subtree([h(str(k)).encode() for k in range(7)], 2, 3)
    top = tree.levels[-1][0]
    assert all(tree.fold(k, leaf) == top for k, leaf in enumerate(tree.levels[0]))
    tree.levels[0][0] = tree.levels[1][0] = tree.levels[2][0] = b"forgotten"
    assert tree.fold(6, h("6").encode()) == top and tree.fold(6, h("7").encode()) != top


def tokens(text):
    import tiktoken

    encoder, _ = S.tokenizer(S.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    return sum(len(encoder.encode_ordinary(text[k : k + S.PIECE])) for k in range(0, len(text), S.PIECE))


RANDOM = "q7Zx0KpV2mW9tRb4YcL8sHd1"
CASES = [
    ('a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b', "assign:2:51,hex:11:51", []),
    ("PassWord: short", "", []),
    ("PassWord: longer", "assign:0:16", []),
    ("paſſword: longer", "", []),
    ("api_key='abc.def' apikey=xyz123 apikey=xyz12", "assign:0:16,assign:18:31", []),
    ("token = secret=abcdef", "assign:0:14,assign:8:21", ["overlap"]),
    (f"éé AKIA{'Z' * 16} AKIAZ", "access:3:23", []),
    (f"x {RANDOM} y", "", [(2, 2 + len(RANDOM))]),
    (f"secret:{RANDOM}", f"assign:0:{7 + len(RANDOM)}", []),
    ("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "", []),
    ("3F2504E0-4F89-41D3-9A0C-0305E82C3301 123456789012345678901234567890", "hex:37:67", []),
    ("2024-01-02 release-v12.4.10-linux/x86.tar docs/internationalisation_guide_2024.html", "", []),
    ("donaudampfschiffahrtsgesellschaftskapitaen qwxzvbnmkjhgfdsaqwpzxtr", "", []),
    ("", "", []),
    (None, "", []),
]


def plain_spans(text):
    """Base spans, by stepping through the text with one match at a time."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (pattern, flags, group, least) in enumerate([(assign, re.IGNORECASE | re.ASCII, 2, 6), ("AKIA[A-Z0-9]+", 0, 0, 20), ("[0-9a-f]+", 0, 0, 24)]):
        at = 0
        while m := re.compile(pattern, flags).search(text, at):
            at = m.end()
            if len(m.group(group)) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_secrets(spark):
    docs = spark.createDataFrame([(k, text, "z") for k, (text, _, _) in enumerate(CASES)], "doc_id long, text string, spans string")
    rows = {r["id"]: r for r in S.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for k, (text, base, dense) in enumerate(CASES):
        r = rows[k]
        spans = r["spans"].split(",") if r["spans"] else []
        fixed = ",".join(s for s in spans if not s.startswith("dense"))
        if dense != ["overlap"]:
            assert fixed == base, text
            assert [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("dense")] == dense, text
        assert r["base_sha256"] == h(fixed)
        assert fixed == S.joined(plain_spans(text or ""))
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["n_dense"]] == [sum(s.startswith(kind) for s in spans) for kind in S.KINDS]


def test_secrets_of_documents(spark):
    """Every run is judged; spans are the fixed shapes and the costly rest."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op12_secret_scan"](spark, folder).collect():
        text, base = texts[r["doc_id"]], plain_spans(texts[r["doc_id"]])
        more = [
            (m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", text)
            if len(m.group()) <= 2 * tokens(m.group()) and not S.is_known(m.group()) and all(b <= m.start() or a >= m.end() for a, _, b in base)]
        assert r["spans"] == S.joined(base + more) and r["base_sha256"] == h(S.joined(base))


def test_long_runs_cost_linear_time(spark):
    docs = spark.createDataFrame([(1, "qZ7" * 400_000), (2, "secret" + " " * 1_000_000)], "doc_id long, text string")
    rows = S.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [r["n_dense"] for r in sorted(rows)] == [1, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(1, 5), st.sampled_from([1, 40, 2**20, 2**40, 2**62]), st.integers(0, 2**32 - 1))
def test_cross_products(n, dims, size, seed):
    x = np.random.default_rng(seed).integers(-size, size, (n, dims), endpoint=True)
    assert (W.cross_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_extreme_entries():
    x = W.whole(np.array([[1e300, -1e300, 0.0, -0.0], [2.0**54, -(2.0**55), -0.001, 3.4e38]]))
    assert x.tolist() == [[W.LONG, -W.LONG, 0, 0], [2**62, -W.LONG, -1, W.LONG]]
    assert (W.cross_products(x) == x.astype(object).T @ x.astype(object)).all()
    assert (W.from_bytes([W.to_bytes(r) for r in x]) == x).all()


def plain_whitening(vectors):
    dims = max(map(len, vectors))
    xs = [[math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(c) - s / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs], values[::-1], axes[:, ::-1], np.array([[c - s / n for c, s in zip(x, sums)] for x in xs])


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 3).astype(np.float32).tolist()
    vectors += vectors[:40] + [vectors[0]] * 50
    bad = [(-1, None, "z"), (-2, [1.0] * 5 + [None], "z"), (-3, [float("nan")] * 6, "z"), (-4, [float("inf")] * 6, "z")]
    rows = [(k, v, "z") for k, v in enumerate(vectors)] + bad
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")).collect()
    n, deviations, values, axes, centred = plain_whitening(vectors)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == 4 * len(vectors) and {r["n"] for r in got} == {n} == {300}
    for c in range(4):
        column = np.array([by[k, c + 1]["whitened"] for k in range(len(vectors))])
        expected = centred @ axes[:, c] / math.sqrt(values[c])
        assert min(np.abs(column - expected).max(), np.abs(column + expected).max()) < 1e-9
        assert abs(by[0, c + 1]["explained"] - values[c] / values.sum()) < 1e-12
    assert [by[k, 1]["deviation"] for k in range(len(vectors))] == deviations
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("vectors,components", [([], 0), ([[]], 0), ([[1.0]], 1), ([[1.0, 2.0]] * 3, 2), ([[1.0], [1.0, 2.0], [0.0, 0.0, 0.0]], 3), ([[1e300, 0.0], [0.0, 1.0]], 2)])
def test_small_whitening(spark, vectors, components):
    rows = W.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == components * len(vectors)
    assert all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in rows)
    if len(set(map(tuple, vectors))) == 1:
        assert all(r["whitened"] == r["deviation"] == r["explained"] == r["identity_error"] == 0 for r in rows)
