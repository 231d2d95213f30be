"""Declared files as they stand on storage: read, hashed and compared in tasks.

Only the few source roots are named by the driver; Spark lists them, reads the files
in tasks and hashes them there. What is declared and what is found meet in a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import code_unit_order


def below(path: Column, root: str) -> Column:
    """The part of a found path below a root, null where it lies elsewhere.

    A root without a scheme, or with that of local files, is compared by path alone,
    since Spark adds scheme and host to what it lists.
    """
    local = re.sub(r"^file:/+", "/", root.rstrip("/"))
    found = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+", "/") if local.startswith("/") else path
    return F.when(F.startswith(found, F.lit(local + "/")), F.substr(found, F.lit(len(local) + 2)))


def found_files(spark: SparkSession, roots: list[str], with_content: bool = True) -> DataFrame:
    """(root, path, bytes[, content, sha256]) of every file below the roots; ``path`` is relative to its root, the longest that fits."""
    if not roots:
        empty = spark.createDataFrame([], "root string, path string, bytes long, content binary, sha256 string")
        return empty if with_content else empty.drop("content", "sha256")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    near = sorted({r.rstrip("/") for r in roots}, key=len, reverse=True)
    placed = F.coalesce(*[F.when(below(F.col("path"), r).isNotNull(), F.struct(F.lit(r).alias("root"), below(F.col("path"), r).alias("path"))) for r in near])
    kept = read.withColumn("_at", placed).select("_at.root", "_at.path", F.col("length").alias("bytes"), *(["content"] if with_content else []))
    return kept.withColumn("sha256", F.sha2("content", 256)) if with_content else kept


def read_declared(spark: SparkSession, declared: DataFrame, roots: list[str]) -> DataFrame:
    """Declared files (``source_id, kind, precedence, root, path``) with ``file``, content, digest and size; content is null for those that do not exist."""
    found = found_files(spark, roots)
    wanted = declared.withColumn("root", F.rtrim(F.col("root"), F.lit("/")))
    return wanted.join(found, ["root", "path"], "left").withColumn("file", F.concat_ws("/", "root", "path"))


def snapshot(read: DataFrame) -> DataFrame:
    """(file, sha256, bytes) of the inputs that were read, each once."""
    return read.filter("sha256 is not null").select("file", "sha256", "bytes").distinct()


def in_list_order(inputs: DataFrame) -> DataFrame:
    return inputs.orderBy(code_unit_order(F.col("file")))


def compared(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Inputs that differ from a recorded snapshot: ``changed``, ``missing`` or ``new``."""
    before = recorded.select("file", F.col("sha256").alias("_before"))
    both = now.select("file", "sha256").join(before, "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_before").isNull(), "new").when(F.col("sha256") != F.col("_before"), "changed")
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def doubled(now: DataFrame) -> DataFrame:
    """Contents that several files share: (sha256, files), the files counted."""
    return now.groupBy("sha256").agg(F.count_distinct("file").alias("files")).filter("files > 1")


def missing_files(official: DataFrame, found: DataFrame) -> DataFrame:
    """Files of an official list (``path``) that a folder lacks; letter case does not count, as on the systems the list comes from."""
    have = found.select(F.lower(F.translate("path", "\\", "/")).alias("_path")).distinct()
    return official.withColumn("_path", F.lower(F.translate("path", "\\", "/"))).join(have, "_path", "left_anti").drop("_path")
