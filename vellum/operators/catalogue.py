"""Catalogue overviews: categories, tools, kinds, and the historical sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import canonical_key, code_unit_order, slugify
from ..functions.labels import display_title, item_category_label
from ..session import durable
from .ordering import game_order, numbered, page_count, with_precedence

# Kinds, page sizes, and the reading order of categories and tools.
KINDS = ["item", "recipe", "encrustment", "skill", "ability", "spell", "monster", "stat", "template"]
CATALOGUE_PAGE = 36
BROWSE_PAGE = 100
CATEGORY_ORDER = [
    "weapon:sword", "weapon:axe", "weapon:mace", "weapon:staff", "weapon:crossbow", "weapon:thrown",
    "weapon:ammunition", "weapon:dagger", "weapon:polearm", "weapon", "armour:head", "armour:chest", "armour:legs",
    "armour:hands", "armour:feet", "armour:waist", "armour:shield", "armour:ring", "armour:neck", "armour:sleeve",
    "armour", "orb", "tome", "food", "booze", "potion", "mushroom", "trap", "wand", "toolkit", "gem", "reagent",
    "material", "item",
]
GROUP_ORDER = ["Weapons", "Armour & equipment", "Food & drink", "Tools & devices", "Crafting materials", "Other"]
TOOL_ORDER = ["lathe", "grinder", "alchemy", "still", "ingot", "smithing", "tinkerer"]


def _rank(value: Column, order: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(place > 0, place).otherwise(F.lit(1_000_000))


def category_group(category: Column) -> Column:
    head = F.get(F.split(category, ":"), 0)
    return (
        F.when(head == "weapon", "Weapons")
        .when((head == "armour") | category.isin("orb", "tome"), "Armour & equipment")
        .when(category.isin("food", "booze", "potion", "mushroom"), "Food & drink")
        .when(category.isin("trap", "wand", "toolkit"), "Tools & devices")
        .when(category.isin("gem", "reagent", "material"), "Crafting materials")
        .otherwise("Other")
    )


def item_categories(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Categories with count, pages and first item in game order, in catalogue order."""
    ranked = with_precedence(items, sources)
    grouped = ranked.groupBy("category").agg(
        F.count(F.lit(1)).alias("item_count"), F.min_by("id", F.struct(*game_order())).alias("first_item"))
    named = grouped.select(
        "category", F.regexp_replace("category", ":", "-").alias("segment"),
        item_category_label(F.col("category")).alias("label"), category_group(F.col("category")).alias("catalogue_group"),
        "item_count", page_count(F.col("item_count"), CATALOGUE_PAGE).alias("pages"), "first_item",
    )
    return named.orderBy(
        _rank(F.col("catalogue_group"), GROUP_ORDER), _rank(F.col("category"), CATEGORY_ORDER),
        code_unit_order(F.col("label")), code_unit_order(F.col("category")))


def category_segment_issues(categories: DataFrame) -> DataFrame:
    """Categories that cannot be a route segment, or that share one."""
    shaped = categories.filter(~F.col("category").rlike("^[a-z0-9]+([-:][a-z0-9]+)*$")).select("category")
    shared = categories.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("category"))
    return shaped.unionByName(shared.filter("n > 1").select("category"))


def craft_tools(recipes: DataFrame, tags: DataFrame, items: DataFrame) -> DataFrame:
    """Tools with their recipe count, and the first toolkit item that carries their tag."""
    counted = recipes.withColumn("tag", canonical_key(F.col("tool"))).groupBy("tag").agg(
        F.count(F.lit(1)).alias("recipe_count"))
    order = F.struct(code_unit_order(F.col("canonical_key")), code_unit_order(F.col("id")))
    first = tags.groupBy(F.col("tag_key").alias("tag")).agg(F.min_by("id", order).alias("first_item"))
    names = items.select(F.col("id").alias("first_item"), F.col("name").alias("_name"))
    joined = counted.join(first, "tag", "left").join(names, "first_item", "left")
    named = joined.select(
        "tag", slugify(F.col("tag")).alias("segment"), F.coalesce("_name", display_title(F.col("tag"))).alias("label"),
        "recipe_count", page_count(F.col("recipe_count"), CATALOGUE_PAGE).alias("pages"), "first_item")
    return named.orderBy(_rank(F.col("tag"), TOOL_ORDER), code_unit_order(F.col("label")), code_unit_order(F.col("tag")))


def kind_counts(entities: DataFrame) -> DataFrame:
    """One row per kind, empty kinds included."""
    spark = entities.sparkSession
    kinds = spark.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in KINDS])).alias("position", "kind"))
    counted = entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, "kind", "left").select(
        "position", "kind", F.coalesce("n", F.lit(0)).alias("entity_count")).orderBy("position")


def dataset_totals(entities: DataFrame, steps: DataFrame, patches: DataFrame) -> DataFrame:
    """Totals of entities, override steps and patch steps in one row."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    union = counted(entities, "entities").unionByName(counted(steps, "overrides")).unionByName(counted(patches, "patches"))
    return union.agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("entities", "overrides", "patches")])


def default_category(categories: DataFrame) -> DataFrame:
    return categories.orderBy(
        F.col("category") != "weapon:sword", _rank(F.col("catalogue_group"), GROUP_ORDER),
        _rank(F.col("category"), CATEGORY_ORDER), code_unit_order(F.col("label")), code_unit_order(F.col("category"))).limit(1)


def default_tool(tools: DataFrame) -> DataFrame:
    return tools.orderBy(_rank(F.col("tag"), TOOL_ORDER), code_unit_order(F.col("label")), code_unit_order(F.col("tag"))).limit(1)


def in_category(items: DataFrame, category: str) -> DataFrame:
    return items.filter(F.col("category") == category)


def with_tool(recipes: DataFrame, tag: str) -> DataFrame:
    return recipes.filter(canonical_key(F.col("tool")) == tag)


def sections(records: DataFrame, group: str, group_rank: Column, member_order: list[Column]) -> DataFrame:
    """Historical sections as sorted rows with the section's size, largest sections included whole."""
    sizes = records.groupBy(group).agg(F.count(F.lit(1)).alias("section_size"))
    return records.join(sizes, group).orderBy(group_rank, F.col(group), *member_order)


def section_rows(records: DataFrame, member_order: list[str]) -> DataFrame:
    """The sections of all kinds at once: each record with its section's number and size, its place in it, and the size of its kind.

    ``records`` has ``kind, id, section, section_rank`` and the columns of the order inside
    a section, which is numbered over range partitions, so a section of any size is fine.
    """
    by = [F.col(c) for c in ("kind", "section", "section_rank")]
    sizes = durable(records.groupingSets([by, by[:1]], *by).agg(F.count(F.lit(1)).alias("n"), F.grouping("section").alias("whole")))
    order = Window.partitionBy("kind").orderBy("section_rank", code_unit_order(F.col("section")))
    by_section = sizes.filter("whole = 0").select("kind", "section", F.col("n").alias("section_size"), F.row_number().over(order).alias("section_number"))
    by_kind = sizes.filter("whole = 1").select("kind", F.col("n").alias("kind_size"))
    placed = numbered(records, ["kind", "section"], member_order).withColumnRenamed("row_number", "position")
    return placed.join(by_section, ["kind", "section"]).join(by_kind, "kind")


def template_cells(templates: DataFrame) -> DataFrame:
    """(template_id, row, column, mark): every cell of a template's rows, counted from zero, for an index from cells to templates."""
    lines = templates.select(F.col("id").alias("template_id"), F.posexplode("rows").alias("row", "line"))
    return lines.select("template_id", "row", F.posexplode(F.split("line", "")).alias("column", "mark")).filter("mark <> ''")


def monster_section(depth: Column, special: Column) -> Column:
    """Section of a monster: special ones apart, then dungeon level 1 to 15, else unknown."""
    return F.when(special, "Special").when(depth.between(1, 15), depth.cast("string")).otherwise("?")


def preview(values: Column, used: Column | int, room: int) -> Column:
    """The first entries that still fit a card."""
    free = F.greatest(F.lit(0), F.lit(room) - (used if isinstance(used, Column) else F.lit(used)))
    return F.slice(values, F.lit(1), free)
