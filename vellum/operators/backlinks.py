"""Reverse lookups. One edge table answers every page, instead of a scan per target.

Spells carry ``id, canonical_key, effects, buffs``. An effect is ``struct<type,
spell_key, spell_id, stat_id, item_id, monster_id, removed_spell_id,
required_spell_id, forbidden_spell_id, buff_tag, options>``, an option
``struct<kind, spell_id, item_id, status>``, a buff ``struct<effects, hooks,
polymorphs, modifiers>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import canonical_key, code_unit_order, fold_text
from ..functions.labels import source_marker

# The relations that count as links to a spell on its page.
SPELL_RELATIONS = [
    "effect", "hook", "option-spell", "condition", "removed-buff", "item-trigger", "macguffin", "instability",
    "ability", "monster-trigger",
]


def all_effects(spells: DataFrame) -> DataFrame:
    """Own effects followed by the effects of buffs, numbered per spell."""
    effects = F.concat("effects", F.flatten(F.transform("buffs", lambda b: b["effects"])))
    return spells.select("id", "canonical_key", F.posexplode(effects).alias("effect_index", "effect"))


def _edge(rows: DataFrame, relation: str, kind: str, target: Column, *positions: Column, note: Column | None = None) -> DataFrame:
    padded = list(positions) + [F.lit(None)] * (3 - len(positions))
    return rows.select(
        F.lit(relation).alias("relation"), F.lit(kind).alias("target_kind"), target.alias("target_id"),
        F.col("id").alias("owner_id"), F.col("canonical_key").alias("owner_key"),
        *[p.cast("int").alias(f"at_{n}") for n, p in enumerate(padded)],
        (note if note is not None else F.lit(None)).cast("string").alias("note"),
    ).filter("target_id is not null")


def effect_links(spells: DataFrame) -> DataFrame:
    return _edge(all_effects(spells), "effect", "spell", F.col("effect.spell_id"), F.col("effect_index"))


def hook_links(spells: DataFrame) -> DataFrame:
    buffs = spells.select("id", "canonical_key", F.posexplode("buffs").alias("buff_index", "buff"))
    hooks = buffs.select("id", "canonical_key", "buff_index", F.posexplode("buff.hooks").alias("hook_index", "hook"))
    return _edge(hooks, "hook", "spell", F.col("hook.spell_id"), F.col("buff_index"), F.col("hook_index"),
                 note=F.col("hook.kind"))


def _options(spells: DataFrame) -> DataFrame:
    return all_effects(spells).select(
        "id", "canonical_key", "effect_index", F.posexplode("effect.options").alias("option_index", "option"))


def option_spell_links(spells: DataFrame) -> DataFrame:
    rows = _options(spells).filter("option.kind = 'spell'")
    return _edge(rows, "option-spell", "spell", F.col("option.spell_id"), F.col("effect_index"), F.col("option_index"))


def option_item_links(spells: DataFrame) -> DataFrame:
    rows = _options(spells).filter("option.kind = 'item' and option.status = 'resolved'")
    return _edge(rows, "option-item", "item", F.col("option.item_id"), F.col("effect_index"), F.col("option_index"))


def item_target_links(spells: DataFrame) -> DataFrame:
    return _edge(all_effects(spells), "item-target", "item", F.col("effect.item_id"), F.col("effect_index"))


def monster_target_links(spells: DataFrame) -> DataFrame:
    return _edge(all_effects(spells), "monster-target", "monster", F.col("effect.monster_id"), F.col("effect_index"))


def polymorph_links(spells: DataFrame) -> DataFrame:
    buffs = spells.select("id", "canonical_key", F.posexplode("buffs").alias("buff_index", "buff"))
    rows = buffs.select("id", "canonical_key", "buff_index", F.posexplode("buff.polymorphs").alias("n", "p"))
    return _edge(rows, "polymorph", "monster", F.col("p.monster_id"), F.col("buff_index"), F.col("n"))


def removed_buff_links(spells: DataFrame) -> DataFrame:
    return _edge(all_effects(spells), "removed-buff", "spell", F.col("effect.removed_spell_id"), F.col("effect_index"))


def condition_links(spells: DataFrame) -> DataFrame:
    """Required and forbidden buffs as one row each."""
    both = all_effects(spells).select(
        "id", "canonical_key", "effect_index",
        F.explode(F.array(
            F.struct(F.lit("forbidden-buff").alias("kind"), F.col("effect.forbidden_spell_id").alias("spell_id")),
            F.struct(F.lit("required-buff").alias("kind"), F.col("effect.required_spell_id").alias("spell_id")),
        )).alias("c"),
    )
    return _edge(both, "condition", "spell", F.col("c.spell_id"), F.col("effect_index"), note=F.col("c.kind"))


def owner_links(owners: DataFrame, relation: str, references: str, target_kind: str = "spell") -> DataFrame:
    """Links from a linked array (``struct<target_id>``) of items, monsters, skills and the like."""
    rows = owners.select("id", "canonical_key", F.posexplode(references).alias("n", "r"))
    return _edge(rows, relation, target_kind, F.col("r.target_id"), F.col("n"))


def spell_edges(spells: DataFrame) -> DataFrame:
    """Every link that starts at a spell."""
    parts = [
        effect_links(spells), hook_links(spells), option_spell_links(spells), option_item_links(spells),
        item_target_links(spells), monster_target_links(spells), polymorph_links(spells),
        removed_buff_links(spells), condition_links(spells),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def backlink_order() -> list[Column]:
    return [code_unit_order(F.col("owner_key")), code_unit_order(F.col("owner_id")), F.col("at_0"), F.col("at_1"),
            F.col("note")]


def backlinks_of(edges: DataFrame, target_kind: str, targets: DataFrame) -> DataFrame:
    """All links to the given targets (column ``id``), of every relation."""
    wanted = targets.select(F.col("id").alias("target_id")).distinct()
    return edges.filter(F.col("target_kind") == target_kind).join(wanted, "target_id", "left_semi")


def backlink_totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target_kind", "target_id").agg(F.count(F.lit(1)).alias("backlinks"))


def distinct_owners(edges: DataFrame) -> DataFrame:
    """Owners per target once each, however often they name it."""
    return edges.select("target_id", "relation", "owner_id").distinct()


# ---- recipes, encrustments, drops, tools -------------------------------------

def recipe_relations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per (item, recipe): amount used, and how many outputs and units it makes.

    Both sides are reduced on the same key in one shuffle; a recipe line without
    a linked item relates to nothing.
    """
    used = inputs.select("item_id", "recipe_id", F.col("amount").alias("used"), F.lit(0).alias("makes"),
                         F.lit(0).cast("bigint").alias("made"))
    made = outputs.select("item_id", "recipe_id", F.lit(0).cast("bigint").alias("used"), F.lit(1).alias("makes"),
                          F.col("amount").alias("made"))
    both = used.unionByName(made).filter("item_id is not null").groupBy("item_id", "recipe_id").agg(
        F.sum("used").cast("bigint").alias("input_amount"), F.sum("makes").cast("bigint").alias("output_count"),
        F.sum("made").cast("bigint").alias("output_amount"))
    return both.filter("input_amount > 0 or output_count > 0")


def encrustment_relations(inputs: DataFrame) -> DataFrame:
    return inputs.filter("item_id is not null").groupBy("item_id", "encrustment_id").agg(
        F.sum("amount").cast("bigint").alias("input_amount")).filter("input_amount > 0")


def drop_relations(monsters: DataFrame) -> DataFrame:
    rows = monsters.select(F.col("id").alias("monster_id"), "canonical_key", F.posexplode("drops").alias("drop_index", "d"))
    return rows.select("monster_id", "canonical_key", "drop_index", F.col("d.item_id").alias("item_id"),
                       F.col("d.chance").alias("chance")).filter("item_id is not null")


def skill_abilities(abilities: DataFrame) -> DataFrame:
    """Abilities per skill in skill order: start ability first, then level, key and id."""
    linked = abilities.filter("skill_id is not null")
    return linked.select("skill_id", "id", "start_skill", "level", "canonical_key").orderBy(
        "skill_id", F.col("start_skill").desc(), "level", code_unit_order(F.col("canonical_key")), code_unit_order(F.col("id")))


def loadout_relations(skills: DataFrame) -> DataFrame:
    """Skills that start with an item, for loadouts whose item is resolved."""
    rows = skills.select(F.col("id").alias("skill_id"), "canonical_key", F.posexplode("loadouts").alias("loadout_index", "l"))
    return rows.filter("l.status = 'resolved'").select(
        F.col("l.item_id").alias("item_id"), "skill_id", "canonical_key", "loadout_index")


def toolkit_tags(items: DataFrame) -> DataFrame:
    """(item, tag key, first declaration that carries the tag)."""
    rows = items.select("id", "canonical_key", F.posexplode("toolkit_tags").alias("declaration_index", "tag"))
    keyed = rows.filter("tag is not null").withColumn("tag_key", canonical_key(F.col("tag")))
    return keyed.groupBy("id", "canonical_key", "tag_key").agg(F.min("declaration_index").alias("declaration_index"))


def tool_users(tags: DataFrame, makers: DataFrame) -> DataFrame:
    """Per tool tag how many items carry it and how many recipes or encrustments need it.

    Items and makers meet only through the tag, so the relation is kept as its
    two sides: listing every (item, maker) pair would repeat each side once per
    row of the other.
    """
    carried = tags.groupBy("tag_key").agg(F.count_distinct("id").alias("items"))
    needed = makers.groupBy(canonical_key(F.col("tool")).alias("tag_key")).agg(F.count(F.lit(1)).alias("makers"))
    return carried.join(needed, "tag_key").withColumn("pairs", F.col("items") * F.col("makers"))


def makers_for_item(tags: DataFrame, makers: DataFrame, item_id: str) -> DataFrame:
    """Recipes or encrustments (``id, tool``) that one item's toolkit serves."""
    own = tags.filter(F.col("id") == item_id).select("tag_key").distinct()
    return makers.withColumn("tag_key", canonical_key(F.col("tool"))).join(own, "tag_key", "left_semi")


def items_for_tag(tags: DataFrame, tag: str) -> DataFrame:
    """Toolkit items of one tag, in key order."""
    wanted = tags.filter(F.col("tag_key") == fold_text(tag))
    return wanted.orderBy(code_unit_order(F.col("canonical_key")), code_unit_order(F.col("id")), "declaration_index")


def used_to_craft(recipes: DataFrame, keep: int = 4) -> DataFrame:
    """The first few other items that an item helps to make.

    Recipes count in key order and their outputs in place order; an output item
    takes the place of its first appearance. Of one recipe only the first
    ``keep + 1`` distinct outputs can matter to any of its inputs (one of them
    may be the item itself), so a recipe sends at most that many candidates per
    input, and the ranking is pruned in the map tasks.
    """
    place = F.struct(code_unit_order(F.col("canonical_key")).alias("k"), code_unit_order(F.col("id")).alias("r"))
    linked = F.array_distinct(F.filter("output_items", lambda o: o.isNotNull()))
    inputs = F.array_distinct(F.filter("input_items", lambda i: i.isNotNull()))
    rows = recipes.select(place.alias("place"), F.slice(linked, 1, keep + 1).alias("outputs"), F.explode(inputs).alias("item_id"))
    pairs = rows.select("item_id", "place", F.posexplode("outputs").alias("n", "output_id")).filter("item_id <> output_id")
    first = pairs.groupBy("item_id", "output_id").agg(F.min(F.struct("place", "n")).alias("first_place"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("first_place"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= keep).select("item_id", "rank", "output_id")


def recipe_cards(recipes: DataFrame, references: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Recipe lines with the shown item name and slug and the recipe's source marker."""
    named = items.select(F.col("id").alias("item_id"), F.col("name").alias("_name"), F.col("slug").alias("item_slug"))
    origin = sources.select(F.col("id").alias("source_id"), source_marker(F.col("id"), F.col("kind"), F.col("label")).alias("marker"))
    heads = recipes.select(F.col("id").alias("recipe_id"), "source_id").join(origin, "source_id", "left")
    lines = references.join(named, "item_id", "left")
    return lines.join(heads, "recipe_id").select(
        "recipe_id", "side", "position", F.coalesce("_name", "item_name").alias("item_name"), "item_slug", "amount", "marker")


def page_stat_owners(uses: DataFrame) -> DataFrame:
    """Owners per stat once each (``owner_kind, owner_id, stat_id``)."""
    return uses.filter("stat_id is not null").select("stat_id", "owner_kind", "owner_id").distinct()


def stat_values(uses: DataFrame) -> DataFrame:
    """Amounts an owner gives a stat, in declaration order (short list per owner and stat)."""
    linked = uses.filter("stat_id is not null")
    return linked.groupBy("stat_id", "owner_kind", "owner_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "amount"))), lambda s: s["amount"]).alias("amounts"))


def declaration_counts(spells: DataFrame) -> DataFrame:
    """How much a spell declares, summed over its buffs and effects."""
    def over_buffs(name: str) -> Column:
        return F.aggregate("buffs", F.lit(0), lambda n, b: n + F.size(b[name]))

    effects = F.concat("effects", F.flatten(F.transform("buffs", lambda b: b["effects"])))
    return spells.select(
        "id", F.size("buffs").alias("buffs"), over_buffs("hooks").alias("hooks"),
        over_buffs("polymorphs").alias("polymorphs"), over_buffs("effects").alias("buff_effects"),
        F.size(F.filter(effects, lambda e: F.size(e["options"]) > 0)).alias("list_effects"),
        F.aggregate(effects, F.lit(0), lambda n, e: n + F.size(e["options"])).alias("list_options"),
        F.size(F.filter(effects, lambda e: e["buff_tag"].isNotNull())).alias("tagged_effects"),
    )


def toolkit_coverage(paths: Column, bounds: Column, controls: Column) -> Column:
    """Counts of declared state images, output coordinates and buttons of a toolkit."""
    declared = lambda values: F.size(F.filter(values, lambda v: v.isNotNull()))
    used = F.filter(controls, lambda c: c["path"].isNotNull() | c["x"].isNotNull() | c["y"].isNotNull())
    return F.struct(declared(paths).alias("states"), declared(bounds).alias("coordinates"), F.size(used).alias("controls"))


# ---- historical links ---------------------------------------------------------

def craft_links_by_name(items: DataFrame, references: DataFrame) -> DataFrame:
    """(item, craft, side) once each, joined on the raw name."""
    named = references.select(F.col("item_name").alias("name"), "craft_id", "side").distinct()
    return items.select("name").distinct().join(named, "name")


def abilities_by_source_skill(skills: DataFrame, abilities: DataFrame) -> DataFrame:
    """Abilities of a skill by its id within one file."""
    left = skills.select("file", F.col("source_skill_id").alias("skill_ref"), F.col("name").alias("skill_name"))
    return left.join(abilities.select("file", "skill_ref", F.col("name").alias("ability_name")), ["file", "skill_ref"])


# The historical crafting tools with the stats they train.
TOOL_STATS = {
    "lathe": ["Wand Crafting"], "grinder": ["Alchemy", "Tinkering"], "alchemy": ["Alchemy"], "still": ["Alchemy"],
    "ingot": ["Smithing", "Tinkering"], "smithing": ["Smithing"], "tinkerer": ["Tinkering"],
}


def tool_stats(tool: Column) -> Column:
    pairs = [x for tag, stats in TOOL_STATS.items() for x in (F.lit(tag), F.array(*[F.lit(s) for s in stats]))]
    return F.try_element_at(F.create_map(*pairs), tool)


def craft_requirements(outputs: DataFrame) -> DataFrame:
    """Each output with every stat its tool asks for (``craft_id, tool, output_index, skill``)."""
    return outputs.select("craft_id", "output_index", F.explode(tool_stats(F.col("tool"))).alias("stat"), "skill")
