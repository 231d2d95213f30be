"""Whole XML trees as a table of nodes, at any depth.

Every element of a file is one row with an interval label: ``node`` counts start
tags from zero, ``last`` is the label of the last element inside it. So an element is
inside another of the same file exactly if its label lies in the other's interval,
and "descendants of" and "nearest enclosing" are range joins within a file. The
reader keeps only the open elements in memory; a row leaves when its element
closes, so neither deep nor wide trees have to fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .xml_records import AMPERSAND, CHUNK, RECORD_TAGS, document_problem, file_text, folded_forms, trimmed

FILE = ["source_id", "file", "kind"]
NODES = T.StructType([
    *[T.StructField(c, T.StringType()) for c in FILE], T.StructField("precedence", T.IntegerType()), T.StructField("node", T.LongType()),
    T.StructField("parent", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("last", T.LongType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("folded", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()),
    T.StructField("problem", T.StringType()), T.StructField("message", T.StringType()),
])
_ROWS_PER_BATCH = 2000
BIN = 256


class _Labels:
    """Rows of closed elements; ``open`` holds one entry per level."""

    def __init__(self):
        self.closed: list[dict] = []
        self.open: list[dict] = []
        self.count = 0
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text

    def start(self, tag: str, attrs: dict[str, str]):
        attrs = {k: trimmed(v) for k, v in attrs.items()}
        self.open.append({
            "node": self.count, "parent": self.open[-1]["node"] if self.open else None, "depth": len(self.open), "tag": tag, "attrs": list(attrs.items()),
            "folded": folded_forms(attrs), "parts": [], "line": self.parser.CurrentLineNumber, "column": self.parser.CurrentColumnNumber + 1,
        })
        self.count += 1

    def text(self, data: str):
        if self.open:
            self.open[-1]["parts"].append(data)

    def end(self, tag: str):
        row = self.open.pop()
        row["text"] = trimmed("".join(row.pop("parts"))) or None
        row["last"] = self.count - 1
        self.closed.append(row)


def _rows(head: dict, text: str) -> Iterator[dict]:
    text = text.replace("&", AMPERSAND)
    problem = document_problem(text)
    if problem:
        code, message, line, column = problem
        yield {**head, "problem": code, "message": message, "line": line, "column": column}
        return
    labels = _Labels()
    for at in range(0, len(text), CHUNK):
        labels.parser.Parse(text[at:at + CHUNK], at + CHUNK >= len(text))
        for row in labels.closed:
            yield {**head, **row}
        labels.closed.clear()


def parse_nodes(files: DataFrame) -> DataFrame:
    """Every element of ``files(source_id, file, kind, precedence, content)``; a file that cannot be read is one row with its ``problem``."""
    schema = to_arrow_schema(NODES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for item in batch.to_pylist():
                for row in _rows(item, file_text(item.pop("content"))):
                    rows.append(row)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(*FILE, "precedence", "content").mapInArrow(read, NODES)


def elements(nodes: DataFrame, *tags: str) -> DataFrame:
    """All elements of some tags, nested ones included."""
    return nodes.filter(F.col("tag").isin(*tags))


def record_elements(nodes: DataFrame) -> DataFrame:
    """The elements that are records in their kind of file."""
    is_record = [(F.col("kind") == kind) & F.col("tag").isin(*tags) for kind, tags in RECORD_TAGS.items()]
    anyone = is_record[0]
    for condition in is_record[1:]:
        anyone = anyone | condition
    return nodes.filter(anyone)


def _inside(inner: DataFrame, outer: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Pairs of (inner row, some columns of an outer element that holds it).

    Labels are cut into bins of ``BIN``, and an interval stands in every bin it touches,
    so the join has an equal key (file and bin) that no single file can overload: in its
    bin an element meets the elements that hold it and those that start or end there.
    Rows of nodes are guessed to be as few as their files, so the joins name their kind:
    a guess would have the nodes of all files sent through the driver.
    """
    bins = F.sequence(F.expr(f"(node + 1) div {BIN}"), F.expr(f"last div {BIN}"))
    named = outer.filter("last > node").select(
        *[F.col(c).alias(f"_{c}") for c in FILE], F.col("node").alias("_from"), F.col("last").alias("_to"), F.explode(bins).alias("_bin"),
        *[F.col(c).alias(n) for c, n in keep.items()])
    same = F.col("_own_bin") == F.col("_bin")
    for c in FILE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = inner.withColumn("_own_bin", F.expr(f"node div {BIN}")).join(named.hint("merge"), same & (F.col("node") > F.col("_from")) & (F.col("node") <= F.col("_to")))
    return met.drop("_own_bin", "_bin", "_from", "_to", *[f"_{c}" for c in FILE])


def descendants(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Every element strictly inside one of ``ancestors``, once for each it is inside of, with ``ancestor`` and the levels between."""
    found = _inside(nodes, ancestors, {"node": "ancestor", "depth": "_depth"})
    return found.withColumn("levels", F.col("depth") - F.col("_depth")).drop("_depth")


def with_nearest(nodes: DataFrame, outer: DataFrame, attribute: str, name: str) -> DataFrame:
    """Each of ``nodes`` with an attribute of the nearest of ``outer`` that holds it and has it, as ``name``; null where none does.

    The candidates of a node are the outer elements on its path, so the aggregate that
    picks the deepest one is as large as the nesting, not as the file.
    """
    holders = outer.withColumn("_value", F.col("attrs")[attribute]).filter("_value is not null")
    near = _inside(nodes.select(*FILE, "node"), holders, {"_value": "_value", "depth": "_depth"}).groupBy(*FILE, "node").agg(F.max_by("_value", "_depth").alias(name))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*FILE, "node"]]
    return nodes.alias("l").join(near.hint("merge").alias("r"), same[0] & same[1] & same[2] & same[3], "left").select("l.*", f"r.{name}")


def unknown_elements(nodes: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Elements at any depth whose parent's tag has a list of allowed children that lacks theirs, once per parent and tag.

    ``allowed`` is a small fixed table from a tag to the tags that may stand directly inside it.
    """
    spark = nodes.sparkSession
    rules = spark.createDataFrame([(tag, list(inner)) for tag, inner in allowed.items()], "_parent_tag string, _allowed array<string>")
    parents = nodes.select(*FILE, F.col("node").alias("parent"), F.col("tag").alias("_parent_tag")).join(F.broadcast(rules), "_parent_tag")
    held = nodes.select(*FILE, "node", "parent", "tag", "line", "column").join(parents.hint("merge"), [*FILE, "parent"])
    strange = held.filter(~F.array_contains("_allowed", F.col("tag")))
    return strange.groupBy(*FILE, "parent", F.col("_parent_tag").alias("parent_tag"), "tag").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("times"), F.min_by("line", "node").alias("line"), F.min_by("column", "node").alias("column"))


def path(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """``path`` of each element of ``of``: the tags from the outermost element down to it."""
    on_way = _inside(of.select(*FILE, "node", F.col("tag").alias("own")), nodes, {"tag": "_tag", "depth": "_at"})
    above = on_way.groupBy(*FILE, "node").agg(F.array_sort(F.collect_list(F.struct("_at", "_tag"))).alias("_steps"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*FILE, "node"]]
    joined = of.alias("l").join(above.hint("merge").alias("r"), same[0] & same[1] & same[2] & same[3], "left")
    steps: Column = F.coalesce(F.transform("r._steps", lambda s: s["_tag"]), F.array().cast("array<string>"))
    return joined.select("l.*", F.concat_ws("/", steps, F.col("l.tag")).alias("path"))
