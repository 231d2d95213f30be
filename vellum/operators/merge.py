"""Merging records of one key by source precedence, with the full history kept as rows.

A key may be declared by very many sources, so nothing here gathers one key into
one task: the winner is an aggregate with map-side combine, and the history is
numbered per (key, source, file) and stitched together over the short list of
files that declare the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import code_unit_order

ENTITY_KEY = ["kind", "canonical_key"]
PROVENANCE = ["source_id", "file", "line", "column", "original_name", "original_id"]


def provenance(prefix: str | None = None) -> Column:
    def pick(name: str) -> Column:
        return F.col(f"{prefix}.{name}" if prefix else name).alias(name)

    return F.struct(*[pick(name) for name in PROVENANCE])


def _content(fields: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]))


def merge_order(fields: list[str]) -> Column:
    """Later is stronger. The content only decides between records of one position."""
    return F.struct(
        F.col("precedence"),
        code_unit_order(F.col("source_id")),
        code_unit_order(F.col("file")),
        F.col("line"),
        F.col("column"),
        code_unit_order(_content(fields)),
    )


def resolve(candidates: DataFrame, fields: list[str], key: list[str] = ENTITY_KEY) -> DataFrame:
    """One row per key: the candidate that comes last in merge order."""
    record = F.struct(*[F.col(c) for c in candidates.columns if c not in key])
    best = candidates.groupBy(*key).agg(
        F.max_by(record, merge_order(fields)).alias("_best"), F.count(F.lit(1)).alias("variant_count")
    )
    kept = [F.col(f"_best.{c}").alias(c) for c in candidates.columns if c not in key]
    return best.select(*key, *kept, "variant_count")


def changed_fields(before: Column, after: Column, fields: list[str]) -> Column:
    """Names of the fields whose values differ, in stored order."""
    marks = [F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in sorted(fields)]
    return F.filter(F.array(*marks), lambda name: name.isNotNull())


def history(candidates: DataFrame, fields: list[str], key: list[str] = ENTITY_KEY) -> DataFrame:
    """Every candidate with its position in its key and the step that replaced its predecessor."""
    run = [*key, "precedence", "source_id", "file"]
    record = F.struct(*[F.col(c) for c in [*PROVENANCE, *fields]])
    inside = F.struct(F.col("line"), F.col("column"), code_unit_order(_content(fields)))
    rows = candidates.withColumn("_record", record).withColumn("_inside", inside)

    runs = rows.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), F.max_by("_record", "_inside").alias("_last"))
    over_runs = Window.partitionBy(*key).orderBy(
        "precedence", code_unit_order(F.col("source_id")), code_unit_order(F.col("file"))
    )
    earlier = over_runs.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *run,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.lag("_last").over(over_runs).alias("_carried"),
    )

    in_run = Window.partitionBy(*run).orderBy("_inside")
    joined = rows.join(runs, run)
    previous = F.coalesce(F.lag("_record").over(in_run), F.col("_carried"))
    numbered = joined.withColumn("position", F.row_number().over(in_run) + F.col("_before")).withColumn(
        "_previous", previous
    )
    return numbered.select(
        *key,
        "position",
        provenance().alias("provenance"),
        F.when(F.col("_previous").isNotNull(), provenance("_previous")).alias("previous"),
        F.when(
            F.col("_previous").isNotNull(), changed_fields(F.col("_previous"), F.col("_record"), fields)
        ).alias("changed_fields"),
    )


def override_steps(steps: DataFrame) -> DataFrame:
    return steps.filter("previous is not null")


def duplicate_notices(steps: DataFrame) -> DataFrame:
    """An information diagnostic for each override step."""
    step = override_steps(steps)
    return step.select(
        F.lit("info").alias("severity"),
        F.lit("duplicate_entity").alias("code"),
        F.concat(
            F.col("provenance.source_id"), F.lit(" overrides "), F.col("previous.source_id"), F.lit(" for "),
            F.col("kind"), F.lit(" "), F.col("provenance.original_name"), F.lit("."),
        ).alias("message"),
        F.col("provenance.source_id").alias("source_id"),
        F.col("provenance.file").alias("file"),
        F.col("provenance.line").alias("line"),
        F.col("provenance.column").alias("column"),
        F.concat_ws(":", "kind", "canonical_key").alias("entity_id"),
        F.create_map(
            F.lit("changedFields"), json_list(F.col("changed_fields")),
            F.lit("previousSourceId"), json_text(F.col("previous.source_id")),
            F.lit("replacementSourceId"), json_text(F.col("provenance.source_id")),
        ).alias("details"),
    )


def json_text(value: Column) -> Column:
    """A string as a JSON literal."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def json_list(values: Column, indent: int = 4) -> Column:
    """An indented JSON array of strings, as nested in a diagnostic's details."""
    pad = " " * (indent + 2)
    inner = F.array_join(F.transform(values, lambda v: F.concat(F.lit(pad), json_text(v))), ",\n")
    return F.when(F.size(values) == 0, "[]").otherwise(
        F.concat(F.lit("[\n"), inner, F.lit("\n" + " " * indent + "]"))
    )


def append_collections(*collections: DataFrame) -> DataFrame:
    """Candidates of several files or kinds as one table."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), collections)


def last_by_name(records: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Loose merge: the record that comes last under its raw name wins."""
    rest = [c for c in records.columns if c != name]
    best = records.groupBy(name).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(name, *[F.col(f"_best.{c}").alias(c) for c in rest])
