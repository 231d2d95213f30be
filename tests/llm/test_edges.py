"""Every pipeline stage and query on awkward tables: nulls everywhere, empty and long texts, repeats, clashing columns, no rows."""

import pytest

import corpus_pipeline
from vellum.llm.queries import QUERIES

LONG = " ".join(f"word{k} of a long text," + ("\n" if k % 50 == 0 else "") for k in range(40_000))
GOOD = " ".join(f"plain{k * 7 % 90}x" for k in range(80))
ROWS = [
    (1, GOOD, "en", "a", 5), (1, GOOD, "en", "a", 5), (2, GOOD, "en", "a", 5), (2, GOOD + " other", None, None, None), (None, GOOD, "en", "a", 5), (None, None, None, None, None),
    (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "de", "a", 4), (6, LONG, "en", "a", 9), (7, LONG + "!", "en", "a", 9), (8, "!?", None, "b", 2), (-9, "Ünïcödé 日本 🙂\x00 " * 30, "xx", "c", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "key", "bucket", "spans", "kept", "words", "node", "id", "row_id", "row_hash", "gone", "leaks", "u", "at", "bands"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame([(*r, *("z",) * len(CLASHING)) for r in ROWS], COLUMNS + "".join(f", {c} string" for c in CLASHING))
    for size, part in (("some", docs), ("none", docs.where("doc_id = 99"))):
        part.repartition(3).write.parquet(f"{folder}/{size}/documents.parquet")
        keep = (lambda df: df) if size == "some" else (lambda df: df.limit(0))
        keep(spark.createDataFrame([(1, "https://casino.com/en/", "<p>x</p>", "c"), (1, None, None, None), (None, "", "", "c")], "page_id long, url string, html string, host string")).write.parquet(f"{folder}/{size}/pages.parquet")
        keep(spark.createDataFrame([(1, GOOD[:200], "c"), (None, GOOD, "c"), (2, None, "c"), (3, "", "c")], "item_id long, text string, leaks string")).write.parquet(f"{folder}/{size}/benchmark.parquet")
        keep(spark.createDataFrame([(1, [1.0, 2.0], "c"), (1, [1.0, 2.0], "c"), (None, [0.5, -1.0], "c"), (2, [0.25], None), (3, [], "c"), (4, None, "c"), (5, [None, 1.0], "c"), (6, [float("nan")], "c")],
                                   "vec_id long, embedding array<float>, vector string")).write.parquet(f"{folder}/{size}/embeddings.parquet")
        keep(spark.createDataFrame([(1, 0, "user", "hi", "c"), (1, 0, "user", "hi", "c"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, parts string")).write.parquet(f"{folder}/{size}/conversations.parquet")
    return folder


@pytest.mark.parametrize("size", ["some", "none"])
def test_stages(spark, tables, size):
    docs = spark.read.parquet(f"{tables}/{size}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tables}/{size}")
        rows = out.collect()
        assert len(rows) <= len(ROWS) and (size == "some" or not rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert all(r["bucket"] == "z" for r in rows)


def test_stage_decisions(spark, tables):
    docs, folder = spark.read.parquet(f"{tables}/some/documents.parquet"), f"{tables}/some"
    stages = {name: {(r["doc_id"], r["text"]) for r in stage(spark, docs, folder).collect()} for name, stage in corpus_pipeline.STAGES[:-1]}
    assert (4, "") not in stages["quality rules"] and (3, None) not in stages["quality rules"] and (1, GOOD) in stages["quality rules"]
    assert (6, LONG) in stages["line dedup"] and (3, None) in stages["line dedup"] and (4, "") in stages["line dedup"] and (7, LONG + "!") not in stages["line dedup"]
    single = stages["MinHash near-dedup"]
    assert {(None, GOOD), (6, LONG), (3, None), (None, None), (4, "")} <= single and (1, GOOD) not in single and (7, LONG + "!") not in single
    assert all(GOOD not in (t or "") for _, t in stages["benchmark decontamination"]) and (6, LONG) in stages["benchmark decontamination"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, tables, name):
    rows = {size: QUERIES[name](spark, f"{tables}/{size}").collect() for size in ("some", "none")}
    table = {"op2": 3, "op6": 3, "op13": 10}.get(name.split("_")[0], len(ROWS))
    assert len(rows["some"]) == table and len(rows["none"]) == (1 if name.startswith("op6") else 0)
