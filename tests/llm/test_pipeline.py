"""The pipeline on the smallest tables, each stage against its operator's brute force, and the registered queries."""

import hashlib

import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from test_byte_bpe import library
from test_lines_and_leaks import brute_lines
from test_near_dedup import brute

from vellum.llm import decontamination as D
from vellum.llm.quality_rules import quality_verdicts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs.cache())
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_schemas(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_stages_match_brute_force(spark, stages):
    docs, good, lines, single, clean, encoded = stages
    kept = {r["id"] for r in quality_verdicts(docs).collect() if r["kept"]}
    assert texts(good) == {k: t for k, t in texts(docs).items() if k in kept} and kept
    shortened = brute_lines(texts(good).items(), 2)
    assert texts(lines) == {k: t for k, t in shortened.items() if t.split() or t == texts(good)[k]}
    classes = brute(list(texts(lines).items()))
    assert texts(single) == {k: t for k, t in texts(lines).items() if classes[k] == k}
    items = [D.normal(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    patterns = [D.Pattern(t, D.BUDGET) for t in items]
    leaky = {k for k, t in texts(single).items() if any(p.nearest(D.normal(t))[0] <= p.budget for p in patterns)}
    assert texts(clean) == {k: t for k, t in texts(single).items() if k not in leaky} and leaky
    enc, left = library(), texts(clean)
    for row in encoded.collect():
        ids = enc.encode_ordinary(left.pop(row["doc_id"]))
        assert row["ids"] == " ".join(map(str, ids)) and row["ids_sha256"] == hashlib.sha256(row["ids"].encode()).hexdigest()
    assert not left and P.PATTERN


def test_run_is_the_stages(spark, stages):
    key = lambda r: r["doc_id"]
    assert sorted(corpus_pipeline.run(spark, SMALL).collect(), key=key) == sorted(stages[-1].collect(), key=key)


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
