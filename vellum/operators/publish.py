"""Publication: stable rows, digests, gated writes with a manifest as commit marker, verified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.checked_lines import FILE_BYTES, list_digest, listed, write_lines
from ..sources.files import found_files
from .diagnostics import may_publish

MANIFEST = "manifest"


def stable_json(columns: list[str], keep_nulls: bool = False) -> Column:
    """A row as JSON with its keys in stored order."""
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), options)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two derivations has and the other lacks; empty when they agree."""
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def table_digest(table: DataFrame) -> DataFrame:
    """Rows, bytes of their JSON lines, and a digest free of order: the sum of the leading 60 bits of each line's sha256."""
    line = stable_json(table.columns, keep_nulls=True)
    lead = F.conv(F.substring(digest(line), 1, 15), 16, 10).cast("decimal(38,0)")
    return table.select(lead.alias("_lead"), (F.octet_length(line) + 1).cast("bigint").alias("_bytes")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("_lead"), F.lit(0)).cast("string").alias("digest"))


def overlaps(output: str, roots: list[str]) -> list[str]:
    """Source roots that contain the output folder or lie within it."""
    def inside(inner: str, outer: str) -> bool:
        return inner == outer or inner.startswith(outer.rstrip("/") + "/")

    return [root for root in roots if inside(output, root) or inside(root, output)]


def _refuse(output: str, diagnostics: DataFrame | None, source_roots: list[str]) -> None:
    blocked = overlaps(output, list(source_roots))
    if blocked:
        raise ValueError(f"output overlaps source roots {blocked}")
    if diagnostics is not None and not may_publish(diagnostics).first()["publishable"]:
        raise ValueError("error diagnostics block publication")


def write_tables(tables: dict[str, DataFrame], output: str, diagnostics: DataFrame | None = None, source_roots: list[str] = ()) -> DataFrame:
    """Write each table as Parquet, then the manifest that makes the set valid.

    Refuses when a diagnostic is an error or when the output would lie in a
    source. The manifest is written last, so an interrupted run leaves a set
    that readers reject.
    """
    _refuse(output, diagnostics, list(source_roots))
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{output}/{name}")
    manifest = manifest_of(spark, list(tables), output)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{output}/{MANIFEST}")
    return spark.read.schema("table_name string, rows long, bytes long, digest string").json(f"{output}/{MANIFEST}")


def manifest_of(spark: SparkSession, names: list[str], output: str) -> DataFrame:
    """Digest rows of the tables as they stand on storage."""
    result = None
    for name in names:
        row = table_digest(spark.read.parquet(f"{output}/{name}")).select(F.lit(name).alias("table_name"), "rows", "bytes", "digest")
        result = row if result is None else result.unionByName(row)
    return result


def read_verified(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """Tables of a published set; fails when one differs from the manifest."""
    stored = spark.read.schema("table_name string, rows long, bytes long, digest string").json(f"{output}/{MANIFEST}")
    names = [row["table_name"] for row in stored.collect()]
    if not names:
        raise ValueError("the set has no manifest")
    if not same_rows(stored, manifest_of(spark, names, output)).isEmpty():
        raise ValueError("the set differs from its manifest")
    return {name: spark.read.parquet(f"{output}/{name}") for name in names}


# ---- files with a checksum each --------------------------------------------------

SET = "table_name string, files long, rows long, bytes long, list_sha256 string"


def serialize_outputs(tables: dict[str, DataFrame], output: str, diagnostics: DataFrame | None = None, source_roots: list[str] = (), file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write each table as files of stable JSON lines, each with its rows, bytes and SHA-256, then the manifest of the set.

    A table's list of files is written when all its tasks are done, the manifest when all
    lists are; it has the digest of each list, so it vouches for every byte of the set.
    """
    _refuse(output, diagnostics, list(source_roots))
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, table in tables.items():
        files = write_lines(table.select(stable_json(table.columns, keep_nulls=True).alias("line")), f"{output}/{name}", file_bytes)
        total = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        rows.append((name, total["files"], total["rows"], total["bytes"], list_digest(f"{output}/{name}")))
    manifest = spark.createDataFrame(rows, SET)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{output}/{MANIFEST}")
    return spark.read.schema(SET).json(f"{output}/{MANIFEST}")


def published_files(spark: SparkSession, output: str, names: list[str]) -> DataFrame:
    """(table_name, file, rows, bytes, sha256) as the lists have them."""
    result = None
    for name in names:
        files = listed(spark, f"{output}/{name}")
        if files is None:
            raise ValueError(f"{name} has no list of files")
        rows = files.select(F.lit(name).alias("table_name"), "file", "rows", "bytes", "sha256")
        result = rows if result is None else result.unionByName(rows)
    return result


def file_problems(spark: SparkSession, output: str) -> DataFrame:
    """(table_name, file, problem) of a published set: lists that are not those of the manifest, files that are missing or changed.

    Files are hashed in tasks. Files that no list names are left over from lost attempts and are no problem.
    """
    manifest = spark.read.schema(SET).json(f"{output}/{MANIFEST}").collect()  # one row per table
    if not manifest:
        raise ValueError("the set has no manifest")
    stale = [(m["table_name"], None, "list changed") for m in manifest if listed(spark, f"{output}/{m['table_name']}") is None or list_digest(f"{output}/{m['table_name']}") != m["list_sha256"]]
    good = [m["table_name"] for m in manifest if m["table_name"] not in {s[0] for s in stale}]
    problems = spark.createDataFrame(stale, "table_name string, file string, problem string")
    if not good:
        return problems
    files = published_files(spark, output, good)
    found = found_files(spark, [f"{output}/{name}" for name in good]).select(
        F.element_at(F.split("root", "/"), -1).alias("table_name"), F.col("path").alias("file"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    checked = files.join(found, ["table_name", "file"], "left")
    problem = F.when(F.col("_sha256").isNull(), "missing").when((F.col("_sha256") != F.col("sha256")) | (F.col("_bytes") != F.col("bytes")), "changed")
    return problems.unionByName(checked.select("table_name", "file", problem.alias("problem")).filter("problem is not null"))


def read_outputs(spark: SparkSession, output: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a set whose every file is as listed; left-over files are not read."""
    problems = file_problems(spark, output).take(5)
    if problems:
        raise ValueError(f"the set differs from its manifest: {[tuple(p) for p in problems]}")
    tables = {}
    for name, schema in schemas.items():
        files = listed(spark, f"{output}/{name}").select(F.col("file").alias("_file"))
        if files.isEmpty():
            tables[name] = spark.createDataFrame([], schema)
            continue
        lines = spark.read.format("text").load(f"{output}/{name}/part-*.jsonl").select(F.from_json("value", schema).alias("r"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"))
        tables[name] = lines.join(files, "_file", "left_semi").select("r.*")
    return tables
