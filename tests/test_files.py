import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from vellum.operators import publish
from vellum.sources import checked_lines, files


def test_published_files_are_as_listed(spark, tmp_path):
    folder = f"{tmp_path}/set"
    rows = spark.range(5000).withColumn("text", F.repeat(F.lit("é"), (F.col("id") % 40).cast("int"))).repartition(5)
    empty = spark.range(0)
    manifest = {r.table_name: r for r in publish.serialize_outputs({"rows": rows, "none": empty}, folder, file_bytes=20_000).collect()}
    listed = [json.loads(x) for x in open(f"{folder}/rows/files.jsonl")]
    assert len(listed) > 5 and manifest["rows"].files == len(listed) and (manifest["none"].files, manifest["none"].rows) == (0, 0)
    for entry in listed:
        content = open(f"{folder}/rows/{entry['file']}", "rb").read()
        assert (hashlib.sha256(content).hexdigest(), len(content), content.count(b"\n")) == (entry["sha256"], entry["bytes"], entry["rows"])
    assert manifest["rows"].list_sha256 == hashlib.sha256(open(f"{folder}/rows/files.jsonl", "rb").read()).hexdigest()
    assert (manifest["rows"].rows, manifest["rows"].bytes) == (5000, sum(e["bytes"] for e in listed))
    assert publish.file_problems(spark, folder).isEmpty()

    open(f"{folder}/rows/part-leftover.jsonl", "w").write('{"id":-1,"text":"lost attempt"}\n')
    back = publish.read_outputs(spark, folder, {"rows": "id long, text string", "none": "id long"})
    assert sorted(map(tuple, back["rows"].collect())) == sorted(map(tuple, rows.collect())) and back["none"].isEmpty()

    path = f"{folder}/rows/{listed[0]['file']}"
    content = bytearray(open(path, "rb").read())
    content[-3] ^= 1
    open(path, "wb").write(content)
    os.remove(f"{folder}/rows/{listed[1]['file']}")
    assert {tuple(r) for r in publish.file_problems(spark, folder).collect()} == {("rows", listed[0]["file"], "changed"), ("rows", listed[1]["file"], "missing")}
    with pytest.raises(ValueError):
        publish.read_outputs(spark, folder, {"rows": "id long, text string"})
    with open(f"{folder}/rows/files.jsonl", "a") as out:
        out.write("\n")
    assert [tuple(r) for r in publish.file_problems(spark, folder).collect()] == [("rows", None, "list changed")]


def test_a_failed_write_leaves_no_list(spark, tmp_path):
    folder = f"{tmp_path}/broken"
    bad = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("string").alias("line"))
    with pytest.raises(Exception):
        checked_lines.write_lines(bad, folder)
    assert checked_lines.listed(spark, folder) is None
    written = checked_lines.write_lines(spark.range(3).selectExpr("cast(id as string) AS line"), folder)
    assert written.agg(F.sum("rows")).first()[0] == 3
    with pytest.raises(ValueError):
        checked_lines.write_lines(spark.range(3).selectExpr("cast(id as string) AS line"), folder)


def test_declared_files_are_read_in_tasks(spark, tmp_path):
    for name, text in {"base/itemDB.xml": "<db/>", "base/sub/Art.PNG": "png", "base/copy.xml": "<db/>", "base2/itemDB.xml": "<x/>"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        open(f"{tmp_path}/{name}", "w").write(text)
    roots = [f"{tmp_path}/base", f"file://{tmp_path}/base2/"]
    declared = spark.createDataFrame([("a", "items", 0, roots[0], "itemDB.xml"), ("a", "items", 0, roots[0], "gone.xml"), ("b", "items", 1, roots[1], "itemDB.xml")],
                                     "source_id string, kind string, precedence int, root string, path string")
    read = files.read_declared(spark, declared, roots).cache()
    got = {(r.source_id, r.path): (bytes(r.content).decode() if r.content is not None else None, r.bytes) for r in read.collect()}
    assert got == {("a", "itemDB.xml"): ("<db/>", 5), ("a", "gone.xml"): (None, None), ("b", "itemDB.xml"): ("<x/>", 4)}
    assert {r.sha256 for r in files.snapshot(read).collect()} == {hashlib.sha256(t).hexdigest() for t in (b"<db/>", b"<x/>")}
    found = files.found_files(spark, roots)
    assert {(r.path, r.root) for r in found.collect()} == {("itemDB.xml", roots[0]), ("sub/Art.PNG", roots[0]), ("copy.xml", roots[0]), ("itemDB.xml", roots[1].rstrip("/"))}
    everything = found.withColumn("file", F.concat_ws("/", "root", "path"))
    assert [(r.sha256, r.files) for r in files.doubled(everything).collect()] == [(hashlib.sha256(b"<db/>").hexdigest(), 2)]
    official = spark.createDataFrame([("SUB\\art.png",), ("ITEMDB.XML",), ("lost.xml",)], "path string")
    assert [r.path for r in files.missing_files(official, found).collect()] == ["lost.xml"]
    now = files.snapshot(read)
    recorded = spark.createDataFrame([(f"{roots[0]}/itemDB.xml", "0"), ("x", "1")], "file string, sha256 string")
    assert {(r.file, r.problem) for r in files.compared(now, recorded).collect()} == {(f"{roots[0]}/itemDB.xml", "changed"), ("x", "missing"), (f"{roots[1]}itemDB.xml", "new")}
    assert files.found_files(spark, []).isEmpty()
