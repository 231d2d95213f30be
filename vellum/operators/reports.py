"""Comparison tables and decision reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import signed_value

MAX_COMPARED = 3  # fixed value: how many items one comparison shows
MISSING = "Not declared"


def compared_slots(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(comparison_id, slot, id): valid, distinct items in request order, at most three.

    ``requests`` has ``comparison_id, position, slug``.
    """
    known = items.select("slug", "id")
    valid = requests.join(known, "slug").groupBy("comparison_id", "id").agg(F.min("position").alias("position"))
    slot = F.row_number().over(Window.partitionBy("comparison_id").orderBy("position"))
    return valid.withColumn("slot", slot).filter(F.col("slot") <= MAX_COMPARED).select("comparison_id", "slot", "id")


def differs(cells: Column) -> Column:
    return F.size(F.array_distinct(cells)) > 1


def comparison_rows(slots: DataFrame, values: DataFrame) -> DataFrame:
    """One row per compared field with a cell per slot.

    ``values`` has ``id, key, label, position, amount``. A field that an item
    lacks reads "Not declared"; a field with several values lists them in order.
    """
    compared = values.join(slots.select("id").distinct(), "id", "left_semi")
    of_item = compared.groupBy("id", "key").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "amount"))), lambda v: signed_value(v["amount"])), ", "
        ).alias("cell"),
        F.max_by("label", "position").alias("label"),
    )
    cells = slots.join(of_item, "id")
    wide = cells.groupBy("comparison_id", "key").agg(
        F.max_by("label", "slot").alias("label"),
        *[F.max(F.when(F.col("slot") == s, F.col("cell"))).alias(f"cell_{s}") for s in range(1, MAX_COMPARED + 1)],
    )
    width = slots.groupBy("comparison_id").agg(F.max("slot").alias("width"))
    shown = wide.join(width, "comparison_id").select(
        "comparison_id", "key", "label", "width",
        *[F.when(F.col("width") >= s, F.coalesce(f"cell_{s}", F.lit(MISSING))).alias(f"cell_{s}")
          for s in range(1, MAX_COMPARED + 1)],
    )
    present = F.filter(F.array(*[F.col(f"cell_{s}") for s in range(1, MAX_COMPARED + 1)]), lambda c: c.isNotNull())
    return shown.withColumn("differs", differs(present)).orderBy("comparison_id", F.collate(F.col("label"), "UNICODE"), "key")


def source_decisions(entities: DataFrame, override_counts: DataFrame, patch_counts: DataFrame) -> DataFrame:
    """Entities whose data was decided by an override or a patch."""
    joined = entities.join(override_counts, ["kind", "id"], "left").join(patch_counts, ["kind", "id"], "left")
    counted = joined.select(
        "kind", "id", "name", "source_id", F.coalesce("overrides", F.lit(0)).cast("bigint").alias("overrides"),
        F.coalesce("patches", F.lit(0)).cast("bigint").alias("patches"))
    return decided_only(counted)


def decided_only(counted: DataFrame) -> DataFrame:
    return counted.filter("overrides > 0 or patches > 0")
