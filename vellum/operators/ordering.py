"""Orders for display and numbering of very long sorted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import code_unit_order
from ..functions.lexemes import SAFE_INTEGER
from ..session import durable


def with_precedence(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_rank``; a source that is not declared ranks last."""
    ranks = sources.select(F.col("id").alias("source_id"), F.col("precedence").cast("bigint").alias("_p"))
    return entities.join(ranks, "source_id", "left").withColumn(
        "source_rank", F.coalesce("_p", F.lit(SAFE_INTEGER))).drop("_p")


def game_order() -> list[Column]:
    return [F.col("source_rank"), code_unit_order(F.col("source_id")), code_unit_order(F.col("file")), F.col("line"),
            F.col("column"), code_unit_order(F.col("id"))]


def item_order(sort: str) -> list[Column]:
    """Catalogue sorts; each falls back to game order."""
    by = {
        "game": [],
        "name": [code_unit_order(F.lower("name")), code_unit_order(F.col("name"))],
        "quality": [F.col("quality")],
        "price": [F.col("price").isNull(), F.col("price")],
        "skill": [F.col("lowest_skill")],
    }
    return [*by[sort], *game_order()]


def source_record_order() -> list[Column]:
    return [F.col("source_rank"), F.col("record")]


def numbered(df: DataFrame, group: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Row numbers per group over sorted data, without putting a group in one task.

    ``order`` takes names and expressions; wrap texts in ``code_unit_order``. An
    empty group numbers the whole table. The number of range partitions is that of
    the session's shuffles unless given.

    The rows are range-partitioned on (group, order), numbered inside each
    partition, and shifted by the number of the group's rows in earlier
    partitions. Only that small table of counts is windowed per group. The
    partitioned rows are made durable first, because both uses must see the same
    partitions.
    """
    names = [f"_order{k}" for k in range(len(order))]
    keyed = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order)})
    keys = [F.col(c) for c in [*group, *names]]
    dealt = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    placed = durable(dealt.withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*names)
    return placed.withColumn("_in", F.row_number().over(inside)).join(shifts, [*group, "_part"]).withColumn(
        "row_number", F.col("_in") + F.col("_before")).drop("_in", "_before", "_part", *names)


def in_stretches(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned on (group, order), with the partition as ``stretch``; durable, so that all later steps see the same ones."""
    return durable(df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn("stretch", F.spark_partition_id()))


def value_before(stretched: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value of the group's earlier rows that is not null, as ``name``.

    ``stretched`` comes from :func:`in_stretches`. Rows look back within their stretch,
    and else to the last value of the group's earlier stretches, of which there are few,
    so a long group is read by as many tasks as it fills.
    """
    valued = stretched.withColumn("_value", value)
    inside = Window.partitionBy(*group, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tails = valued.groupBy(*group, "stretch").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail"))
    earlier = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*group, "stretch", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    looked = valued.withColumn("_near", F.last("_value", ignorenulls=True).over(inside)).join(carried, [*group, "stretch"])
    return looked.withColumn(name, F.coalesce("_near", "_carried")).drop("_value", "_near", "_carried")


def page_count(rows: Column, size: int | None) -> Column:
    return F.lit(1).cast("bigint") if size is None else F.greatest(F.lit(1).cast("bigint"), F.ceil(rows / size))


def with_pages(df: DataFrame, group: list[str], order: list[str | Column], size: int) -> DataFrame:
    """Every row with its page, for publishing all pages at once."""
    return numbered(df, group, order).withColumn("page", F.ceil(F.col("row_number") / size))


def one_page(df: DataFrame, order: list[Column], page: int, size: int | None) -> DataFrame:
    """One page of a sorted list; a page beyond the end has no rows."""
    if page < 1 or (size is None and page > 1):
        return df.limit(0)
    ordered = df.orderBy(*order)
    return ordered if size is None else ordered.offset((page - 1) * size).limit(size)
