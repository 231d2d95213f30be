"""Inheritance, chains, demand plans, derived stats and rankings over the test tables."""

from pyspark.sql import Window, functions as F

from ..operators import derived_stats
from ..plans import chains, crafting, inheritance
from . import views  # noqa: F401
from .registry import VIEWS, query, source, table

# ---- inheritance ------------------------------------------------------------------------

VIEWS["climb_v"] = """
WITH RECURSIVE walk AS (SELECT part_no AS start, parent_no AS spot, 1 AS depth FROM parents_v
  UNION ALL SELECT w.start, p.parent_no, w.depth + 1 FROM walk w JOIN parents_v p ON p.part_no = w.spot WHERE w.depth < 30)
SELECT * FROM walk WHERE spot IS NOT NULL"""
VIEWS["members_v"] = "SELECT DISTINCT start AS part_no FROM climb_v WHERE start = spot"
VIEWS["tree_v"] = """
SELECT p.*, CASE WHEN m.part_no IS NULL AND k.part_no IS NOT NULL THEN p.parent_no END AS up, m.part_no IS NOT NULL AS member, k.part_no IS NULL AND p.parent_no IS NOT NULL AS lost
FROM parents_v p LEFT JOIN members_v m ON m.part_no = p.part_no LEFT JOIN parents_v k ON k.part_no = p.parent_no"""
VIEWS["above_v"] = """
WITH RECURSIVE up AS (SELECT part_no AS start, part_no AS spot, 0 AS depth FROM tree_v
  UNION ALL SELECT u.start, t.up, u.depth + 1 FROM up u JOIN tree_v t ON t.part_no = u.spot WHERE t.up IS NOT NULL)
SELECT u.start, u.depth AS far, t.* FROM up u JOIN tree_v t ON t.part_no = u.spot"""


def monsters(spark, sf):
    p = source(spark, sf, "parents_v")
    return p.select(
        F.col("part_no").alias("key"), F.col("parent_no").alias("parent_key"), "description", F.col("depth").alias("dungeon_depth"), "icon", "source_id",
        F.create_map(F.concat(F.lit("damage:"), "mod_key"), "mod_amount").alias("modifiers"))


def _inherited(spark, sf):
    return inheritance.inherit(monsters(spark, sf), ["description", "dungeon_depth", "icon"], ["description"], "modifiers")


@query("I01_inheritance", """
SELECT start AS part_no, max(up) FILTER (far = 0) AS inherits_from, arg_min(description, far) FILTER (description <> '') AS description,
  arg_min(depth, far) FILTER (depth IS NOT NULL) AS dungeon_depth, arg_min(icon, far) FILTER (icon IS NOT NULL) AS icon,
  arg_min(mod_amount, far) FILTER (mod_key = '1') AS damage_1, count(DISTINCT mod_key) AS modifier_count FROM above_v GROUP BY start""")
def inherit(spark, sf):
    resolved, _ = _inherited(spark, sf)
    return resolved.select(
        F.col("key").alias("part_no"), "inherits_from", "description", "dungeon_depth", "icon",
        F.try_element_at("modifiers", F.lit("damage:1")).alias("damage_1"), F.size("modifiers").cast("bigint").alias("modifier_count"))


@query("I01_inheritance_issues", "SELECT part_no, CASE WHEN member THEN 'cycle' ELSE 'missing-parent' END AS issue FROM tree_v WHERE member OR lost")
def inherit_issues(spark, sf):
    return _inherited(spark, sf)[1].select(F.col("key").alias("part_no"), "issue")


def declared_monsters(spark, sf):
    """Monsters with a chance for some, a modifier each, and three triggers."""
    p = source(spark, sf, "parents_v")
    trigger = lambda kind, chance: F.struct(F.lit(kind).alias("kind"), F.lit("spell").alias("spell_name"), F.expr(chance).cast("bigint").alias("chance"))
    modifier = lambda kind, key, amount: F.struct(F.lit(kind).alias("kind"), key.alias("source_key"), amount.cast("double").alias("amount"))
    return p.select(
        F.col("part_no").alias("canonical_key"), F.col("parent_no").alias("inherits_key"), "description", F.lit("").alias("taxonomy"), "depth", F.col("icon").alias("icon_path"),
        F.lit(None).cast("string").alias("palette_name"), F.lit(None).cast("bigint").alias("palette_tint"), F.expr("CASE WHEN part_no % 3 = 1 THEN part_no % 100 END").cast("bigint").alias("spell_chance"),
        F.array(modifier("resistance", F.lit("acid"), F.col("part_no")), modifier("damage", F.col("mod_key"), F.lit(-1)), modifier("damage", F.col("mod_key"), F.col("mod_amount"))).alias("modifiers"),
        F.array(trigger("cast-when-aware", "NULL"), trigger("cast-when-aware", "7"), trigger("on-hit", "NULL")).alias("triggers"))


@query("I01_monster_pass_down", """
SELECT start AS part_no, arg_min(CASE WHEN part_no % 3 = 1 THEN part_no % 100 END, far) FILTER (part_no % 3 = 1) AS spell_chance,
  CASE WHEN max(up) FILTER (far = 0) IS NOT NULL THEN arg_min(CASE WHEN part_no % 3 = 1 THEN part_no % 100 END, far) FILTER (part_no % 3 = 1) END AS first_cast, 7 AS second_cast, CAST(NULL AS BIGINT) AS on_hit,
  coalesce(arg_min(description, far) FILTER (description <> ''), '') AS description, 1 + count(DISTINCT mod_key) AS modifiers, arg_min(mod_amount, far) FILTER (mod_key = '1') AS damage_1, CAST(start AS DOUBLE) AS last_amount
FROM above_v GROUP BY start""", big="spell_chance first_cast second_cast modifiers")
def monster_pass_down(spark, sf):
    """Spell chance, the casts that take it, texts, and modifiers, whatever the depth of the chain."""
    resolved, _ = inheritance.inherit_monsters(declared_monsters(spark, sf))
    cast = lambda i: F.get("triggers", F.lit(i))["chance"]
    return resolved.select(
        F.col("canonical_key").alias("part_no"), "spell_chance", cast(0).alias("first_cast"), cast(1).alias("second_cast"), cast(2).alias("on_hit"), "description",
        F.size("modifiers").cast("bigint").alias("modifiers"), F.get(F.filter("modifiers", lambda m: (m["kind"] == "damage") & (m["source_key"] == "1")), F.lit(0))["amount"].alias("damage_1"),
        F.element_at("modifiers", -1)["amount"].alias("last_amount"))


@query("I02_appearance_sources", """
SELECT start AS part_no, arg_min(source_id, far) FILTER (icon IS NOT NULL) AS icon_source FROM above_v GROUP BY start""")
def appearance(spark, sf):
    return inheritance.appearance_sources(monsters(spark, sf), ["icon"]).select(F.col("key").alias("part_no"), "icon_source")


# ---- chains --------------------------------------------------------------------------------

def chain_edges(spark, sf):
    """Each spell leads to two smaller ones, one leads back up, some name an unknown spell."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("source"))
    targets = F.array(
        F.expr("CASE WHEN source >= 2 THEN source div 2 WHEN source = 1 THEN 6 END"), F.expr("CASE WHEN source >= 3 THEN source div 3 END"),
        F.expr("CASE WHEN source % 7 = 3 THEN -1L END"))
    rows = p.select("source", F.posexplode(targets).alias("position", "target")).filter("target is not null")
    return rows.select("source", "position", F.col("target").cast("bigint").alias("target"), (F.col("target") >= 0).alias("known"))


@query("I03_effect_chain")
def effect_chain(spark, sf):
    roots = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return chains.effect_chain(roots, chain_edges(spark, sf))


@query("I03_reachable_edges", """
WITH RECURSIVE links_v AS (
  SELECT p_partkey AS source, 0 AS position, p_partkey // 2 AS target FROM part WHERE p_partkey >= 2 UNION ALL SELECT 1, 0, 6
  UNION ALL SELECT p_partkey, 1, p_partkey // 3 FROM part WHERE p_partkey >= 3 UNION ALL SELECT p_partkey, 2, -1 FROM part WHERE p_partkey % 7 = 3),
opened AS (SELECT p_partkey AS root, p_partkey AS source FROM part UNION SELECT o.root, l.target FROM opened o JOIN links_v l USING (source) WHERE l.target >= 0)
SELECT root, source, position, target FROM opened JOIN links_v USING (source)""")
def reachable_edges(spark, sf):
    roots = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return chains.reachable(roots, chain_edges(spark, sf)).select("root", "source", "position", "target")


# ---- demand ----------------------------------------------------------------------------------

def bom(spark, sf, extra=False, back_edge=False):
    """Options and inputs: part p is made from p div 2 and p div 3, yielding one or two."""
    parts = table(spark, sf, "part").filter("p_partkey >= 2").select(F.col("p_partkey").alias("item_id"))
    outputs = parts.select(
        F.concat(F.lit("r"), "item_id").alias("recipe_id"), F.concat(F.lit("r"), "item_id").alias("recipe_key"), F.lit(0).alias("output_index"), "item_id",
        F.lit(0).alias("skill_level"), (1 + F.col("item_id") % 2).alias("yield"))
    inputs = source(spark, sf, "bom_v").select(
        F.concat(F.lit("r"), "parent").alias("recipe_id"), F.col("child").alias("item_id"), F.concat(F.lit("part "), "child").alias("item_key"),
        F.concat(F.lit("Part "), "child").alias("item_name"), F.col("per_craft").cast("bigint").alias("amount"), "place")
    if extra:
        several = parts.filter("item_id % 5 = 4")
        outputs = outputs.unionByName(several.select(
            F.concat(F.lit("a"), "item_id").alias("recipe_id"), F.concat(F.lit("a"), "item_id").alias("recipe_key"), F.lit(0).alias("output_index"),
            "item_id", F.lit(1).alias("skill_level"), F.lit(1).cast("bigint").alias("yield")))
        unknown = F.lit(None).cast("bigint")
        inputs = inputs.unionByName(several.select(
            F.concat(F.lit("a"), "item_id").alias("recipe_id"), F.expr("item_id div 2").alias("item_id"), F.lit("k").alias("item_key"), F.lit("n").alias("item_name"),
            F.lit(1).cast("bigint").alias("amount"), F.lit(0).alias("place"))).unionByName(parts.filter("item_id % 7 = 3").select(
                F.concat(F.lit("r"), "item_id").alias("recipe_id"), unknown.alias("item_id"), F.lit("mystery").alias("item_key"), F.lit("Mystery").alias("item_name"),
                F.lit(2).cast("bigint").alias("amount"), F.lit(2).alias("place")))
    if back_edge:
        one = table(spark, sf, "part").filter("p_partkey = 1")
        outputs = outputs.unionByName(one.select(F.lit("r1").alias("recipe_id"), F.lit("r1").alias("recipe_key"), F.lit(0).alias("output_index"),
                                                 F.col("p_partkey").alias("item_id"), F.lit(0).alias("skill_level"), F.lit(1).cast("bigint").alias("yield")))
        inputs = inputs.unionByName(one.select(F.lit("r1").alias("recipe_id"), F.lit(6).cast("bigint").alias("item_id"), F.lit("part 6").alias("item_key"),
                                               F.lit("Part 6").alias("item_name"), F.lit(1).cast("bigint").alias("amount"), F.lit(0).alias("place")))
    return crafting.output_options(outputs), inputs


def demand_sql(requirements):
    """Demand level by level: p div 2 and p div 3 have fewer binary digits than p."""
    parts, top = [], 17
    for bits in range(top, 0, -1):
        sources = [f"SELECT plan_id, item_id, amount FROM ({requirements}) WHERE length(bin(item_id)) = {bits}"]
        if bits < top:
            sources.append(f"SELECT plan_id, item_id // 2, crafts * (1 + item_id % 3) FROM d{bits + 1} WHERE crafts IS NOT NULL")
            sources += [f"SELECT plan_id, item_id // 3, crafts FROM d{b} WHERE crafts IS NOT NULL AND item_id >= 3 AND length(bin(item_id // 3)) = {bits}"
                        for b in (bits + 1, bits + 2) if b <= top]
        parts.append(f"""d{bits} AS MATERIALIZED (SELECT plan_id, item_id, required, CASE WHEN item_id >= 2 THEN CAST(ceil(required / (1 + item_id % 2)) AS BIGINT) END AS crafts
          FROM (SELECT plan_id, item_id, CAST(sum(amount) AS BIGINT) AS required FROM ({' UNION ALL '.join(sources)}) GROUP BY plan_id, item_id))""")
    return "WITH " + ",\n".join(parts), " UNION ALL ".join(f"SELECT * FROM d{b}" for b in range(top, 0, -1))


BRAND_WANTS = "SELECT p_brand AS plan_id, p_partkey AS item_id, p_size AS amount FROM part UNION ALL SELECT p_brand, p_partkey // 2, 1 FROM part WHERE p_partkey >= 2"
PART_WANTS = "SELECT CAST(p_partkey AS VARCHAR) AS plan_id, p_partkey AS item_id, 1 + p_partkey % 5 AS amount FROM part"


def brand_wants(spark, sf):
    p = table(spark, sf, "part")
    first = p.select(F.col("p_brand").alias("plan_id"), F.col("p_partkey").alias("item_id"), F.col("p_size").cast("bigint").alias("amount"))
    return first.unionByName(p.filter("p_partkey >= 2").select(
        F.col("p_brand").alias("plan_id"), F.expr("p_partkey div 2").alias("item_id"), F.lit(1).cast("bigint").alias("amount")))


def part_wants(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("plan_id"), F.col("p_partkey").alias("item_id"), (1 + F.col("p_partkey") % 5).alias("amount"))


STEP_COLUMNS = "plan_id, item_id, required AS required_amount, crafts AS craft_count, crafts * (1 + item_id % 2) AS produced_amount, crafts * (1 + item_id % 2) - required AS surplus_amount"
_head, _all = demand_sql(BRAND_WANTS)
query("I07_demand", f"{_head} SELECT {STEP_COLUMNS} FROM ({_all}) WHERE crafts IS NOT NULL")(
    lambda spark, sf: crafting.plan(brand_wants(spark, sf), *bom(spark, sf))["steps"].select(
        "plan_id", "item_id", "required_amount", "craft_count", "produced_amount", "surplus_amount"))
query("I09_combined_requirements", f"{_head} SELECT plan_id, item_id, required AS amount FROM ({_all}) WHERE crafts IS NULL")(
    lambda spark, sf: crafting.plan(brand_wants(spark, sf), *bom(spark, sf))["base"])
_head2, _all2 = demand_sql(PART_WANTS)
query("I08_crafting_plan", f"{_head2} SELECT {STEP_COLUMNS} FROM ({_all2}) WHERE crafts IS NOT NULL")(
    lambda spark, sf: crafting.plan(part_wants(spark, sf), *bom(spark, sf))["steps"].select(
        "plan_id", "item_id", "required_amount", "craft_count", "produced_amount", "surplus_amount"))

VIEWS["visited_v"] = """
WITH RECURSIVE visited AS (SELECT CAST(p_partkey AS VARCHAR) AS plan_id, p_partkey AS item_id FROM part
  UNION SELECT v.plan_id, u.child FROM visited v JOIN (SELECT parent, child FROM bom_v WHERE NOT (parent % 5 = 4)
    UNION ALL SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 10 = 9) u ON u.parent = v.item_id)
SELECT * FROM visited"""


def selected(spark, sf):
    """Each plan picks the alternative for the items that end in nine."""
    p = table(spark, sf, "part")
    picks = p.filter("p_partkey % 10 = 9").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("a"), "p_partkey", F.lit("#0")).alias("option_key"))
    reach = crafting.discover(part_wants(spark, sf), *bom(spark, sf), columns=["plan_id", "item_id"])[0]
    return reach.join(picks, "item_id")


def chosen_plan(spark, sf):
    return crafting.plan(part_wants(spark, sf), *bom(spark, sf, extra=True), selected(spark, sf))


query("I05_plan_nodes", """
SELECT plan_id, item_id, CASE WHEN item_id < 2 THEN 'base' WHEN item_id % 5 = 4 AND item_id % 10 <> 9 THEN 'choice' ELSE 'recipe' END AS node FROM visited_v""")(
    lambda spark, sf: crafting.discover(part_wants(spark, sf), *bom(spark, sf, extra=True), selected(spark, sf), columns=["plan_id", "item_id", "node"])[0])
query("R04_choice_list", "SELECT plan_id, item_id, item_id % 10 = 9 AS is_selected FROM visited_v WHERE item_id >= 2 AND item_id % 5 = 4")(
    lambda spark, sf: (lambda r: crafting.choice_list(r["choices"], r["selected"]).select("plan_id", "item_id", F.col("option_key").isNotNull().alias("is_selected")))(
        chosen_plan(spark, sf)))
query("I08_completeness", """SELECT plan_id, NOT bool_or(item_id >= 2 AND item_id % 10 = 4 OR item_id >= 2 AND item_id % 7 = 3 AND item_id % 5 <> 4) AS complete FROM visited_v GROUP BY plan_id""")(
    lambda spark, sf: chosen_plan(spark, sf)["complete"])


@query("I06_cycle_report")
def cycle_report(spark, sf):
    """Every part that is made from part one closes a cycle, since one needs six."""
    options, inputs = bom(spark, sf, back_edge=True)
    wants = part_wants(spark, sf)
    _, edges = crafting.discover(wants, options, inputs)
    ordered = edges.select("plan_id", "parent", "child", F.format_string("part %d", F.col("child")).alias("child_order"))
    starts = wants.select("plan_id", "item_id", F.lit(0).alias("start_order"))
    return chains.cycle_report(ordered, starts).select("plan_id", F.array_join(F.transform("cycle", lambda c: c.cast("string")), ">").alias("cycle"))


query("I06_cyclic_plans", "SELECT CAST(p_partkey AS VARCHAR) AS plan_id, p_partkey = 0 AS complete FROM part")(
    lambda spark, sf: crafting.plan(part_wants(spark, sf), *bom(spark, sf, back_edge=True))["complete"])


def line_ingredients(spark, sf):
    known = F.expr("CASE WHEN l_partkey % 4 <> 1 THEN l_partkey END")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("e"), F.expr("l_suppkey % 20")).alias("owner_id"), known.alias("item_id"), F.concat(F.lit("part "), F.expr("l_partkey % 100")).alias("item_key"),
        F.concat(F.lit("Part "), F.expr("l_partkey % 100")).alias("item_name"), F.col("l_quantity").cast("bigint").alias("amount"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("position"))


def part_items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


@query("A03_aggregate_inputs", """
SELECT 'e' || l_suppkey % 20 AS owner_id, CASE WHEN l_partkey % 4 <> 1 THEN l_partkey END AS item_id, CASE WHEN l_partkey % 4 = 1 THEN 'part ' || l_partkey % 100 END AS unresolved_key,
  CAST(sum(l_quantity) AS BIGINT) AS amount FROM lineitem GROUP BY ALL""")
def aggregate_inputs(spark, sf):
    summed = crafting.aggregate_inputs(line_ingredients(spark, sf), ["owner_id"], part_items(spark, sf))
    return summed.select("owner_id", "item_id", F.when(F.col("item_id").isNull(), F.col("item_key")).alias("unresolved_key"), "amount")


ENCRUST_WANTS = "SELECT 'e' || l_suppkey % 20 AS plan_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) * (1 + (l_suppkey % 20) % 3) AS amount FROM lineitem WHERE l_partkey % 4 <> 1"
_head3, _all3 = demand_sql(ENCRUST_WANTS)


def encrust(spark, sf):
    owners = line_ingredients(spark, sf).select("owner_id").distinct().select(
        F.col("owner_id").alias("plan_id"), "owner_id", (1 + F.substring("owner_id", 2, 9).cast("bigint") % 3).alias("times"))
    return crafting.encrustment_plan(owners, line_ingredients(spark, sf), part_items(spark, sf), *bom(spark, sf))


query("I10_encrustment_plan", f"{_head3} SELECT {STEP_COLUMNS} FROM ({_all3}) WHERE crafts IS NOT NULL")(
    lambda spark, sf: encrust(spark, sf)["steps"].select("plan_id", "item_id", "required_amount", "craft_count", "produced_amount", "surplus_amount"))
query("I10_unresolved", """SELECT 'e' || l_suppkey % 20 AS plan_id, 'part ' || l_partkey % 100 AS item_key, CAST(sum(l_quantity) * (1 + (l_suppkey % 20) % 3) AS BIGINT) AS amount
FROM lineitem WHERE l_partkey % 4 = 1 GROUP BY l_suppkey % 20, l_partkey % 100""")(
    lambda spark, sf: encrust(spark, sf)["unresolved"].select("plan_id", "item_key", "amount"))


def recipe_outputs(spark, sf):
    return source(spark, sf, "recipes_v").select(
        F.col("id").alias("recipe_id"), F.col("canonical_key").alias("recipe_key"), F.lit(0).alias("output_index"),
        F.expr("CASE WHEN output_no % 3 <> 0 THEN output_no END").alias("item_id"), "skill_level", F.col("output_amount").alias("yield"))


VIEWS["options_v"] = """SELECT output_no AS item_id, id || '#0' AS option_key, CAST(row_number() OVER (PARTITION BY output_no ORDER BY canonical_key, id) AS INT) AS option_rank
FROM recipes_v WHERE output_no % 3 <> 0"""
query("I04_output_options", "SELECT item_id, option_key FROM options_v")(
    lambda spark, sf: crafting.output_options(recipe_outputs(spark, sf)).select("item_id", "option_key"))
query("T08_option_order", "SELECT item_id, option_key, option_rank FROM options_v")(
    lambda spark, sf: crafting.ranked_options(crafting.output_options(recipe_outputs(spark, sf))).select(
        "item_id", "option_key", F.col("option_rank").cast("int").alias("option_rank")))
query("P07_craftable_items", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT item_id FROM options_v)")(
    lambda spark, sf: crafting.craftable(part_items(spark, sf), recipe_outputs(spark, sf)))
query("I08_invalid_requirements", """SELECT o_orderkey AS plan_id, CASE WHEN p_partkey IS NULL THEN 'unknown item' ELSE 'amount not a positive integer' END AS reason
FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2 WHERE p_partkey IS NULL OR o_orderkey % 5 = 0""")(
    lambda spark, sf: crafting.invalid_requirements(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") * 2).alias("item_id"), F.expr("o_orderkey % 5").alias("amount")), part_items(spark, sf)).select("plan_id", "reason"))


@query("R05_choice_tokens", """
SELECT plan_id, item_id, arg_max(option_key, position) AS option_key FROM (
  SELECT 'plan' || o.o_orderkey % 50 AS plan_id, v.item_id, v.option_key, o.o_orderkey AS position FROM orders o JOIN options_v v
    ON v.option_key = 'recipe:' || o.o_orderkey || '#0') GROUP BY plan_id, item_id""")
def choice_tokens(spark, sf):
    options = crafting.output_options(recipe_outputs(spark, sf))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("i-"), "p_partkey").alias("slug"))
    recipes = source(spark, sf, "recipes_v").select("id", F.concat(F.lit("r-"), "recipe_no").alias("slug"))
    given = table(spark, sf, "orders").select(
        F.concat(F.lit("plan"), F.expr("o_orderkey % 50")).alias("plan_id"), F.col("o_orderkey").alias("position"),
        F.concat(F.lit("i-"), "o_custkey", F.lit("~r-"), "o_orderkey", F.lit("~0")).alias("token"))
    return crafting.selections_from_tokens(given, crafting.choice_tokens(options, items, recipes))


# ---- derived stats -----------------------------------------------------------------------------

def levels(spark, sf):
    mod = lambda kind, key, amount: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("source_key"), F.col(amount).alias("amount"))
    raw = source(spark, sf, "levels_v")
    return raw.withColumn("modifiers", F.array(
        mod("primary", "0", "a1"), mod("primary", "0", "a2"), mod("primary", "4", "a1"), mod("damage", "crushing", "a1"), mod("damage", "voltaic", "a2"),
        mod("damage", "blasting", "a2"))).withColumn("record", F.col("id"))


PRIMARY_SQL = " UNION ALL ".join(
    f"SELECT id, '{label}' AS attribute, CAST({a} * fighter + {b} * rogue + {c} * wizard AS DOUBLE) AS base, {m} AS modifier FROM levels_v"
    for label, a, b, c, m in [("Burliness", 2, 1, 1, "a2"), ("Sagacity", 1, 1, 2, "0.0::DOUBLE"), ("Nimbleness", 1, 2, 1, "0.0::DOUBLE"),
                              ("Caddishness", 2, 2, 1, "0.0::DOUBLE"), ("Stubbornness", 2, 1, 2, "a1"), ("Savvy", 1, 2, 2, "0.0::DOUBLE")])
query("A14_primary_attributes", f"SELECT id, attribute, base, modifier, base + modifier AS total FROM ({PRIMARY_SQL})")(
    lambda spark, sf: derived_stats.primary_attributes(levels(spark, sf)))
ARMOUR = "SELECT id, name, CAST(floor((2 * fighter + rogue + wizard - 5) / 3.0) AS BIGINT) AS archetype_contribution, a1 + a2 AS damage_modifiers FROM levels_v"
query("A15_required_armour", f"SELECT *, archetype_contribution + damage_modifiers AS required_armour FROM ({ARMOUR})")(
    lambda spark, sf: derived_stats.required_armour(levels(spark, sf)))
query("T04_rank_required_armour", f"""SELECT id, required_armour FROM (SELECT id, name, archetype_contribution + damage_modifiers AS required_armour FROM ({ARMOUR}))
ORDER BY required_armour DESC, name, CAST(id AS VARCHAR) LIMIT 10""")(
    lambda spark, sf: derived_stats.rank_required_armour(levels(spark, sf).withColumn("id", F.col("id").cast("string"))).select(
        F.col("id").cast("bigint").alias("id"), "required_armour"))


def bonus(spark, sf):
    return source(spark, sf, "modifiers_v").select(
        F.col("owner_no").alias("id"), F.concat("modifier_kind", F.lit(":"), "source_key").alias("stat"), "amount", "position")


query("A16_merge_stats", "SELECT owner_no AS id, modifier_kind || ':' || source_key AS stat, sum(amount) AS amount, min(position) AS position FROM modifiers_v GROUP BY ALL")(
    lambda spark, sf: derived_stats.merge_stats(bonus(spark, sf), ["id"]))
LEVEL_SQL = {
    "Burliness": "2*fighter+rogue+wizard", "Sagacity": "fighter+rogue+2*wizard", "Nimbleness": "fighter+2*rogue+wizard", "Caddishness": "2*fighter+2*rogue+wizard",
    "Stubborness": "2*fighter+rogue+2*wizard", "Savvy": "fighter+2*rogue+2*wizard", "Life": "5+4*fighter+3*rogue+2*wizard", "Mana": "2*fighter+2*rogue+4*wizard",
    "Melee Power": "floor((2*fighter+rogue+wizard-5)/3.0)", "Magic Power": "floor((fighter+rogue+2*wizard)/2.0)", "Crit": "floor((2*fighter+2*rogue+wizard)/2.0)",
    "Haywire": "floor((fighter+2*rogue+2*wizard)/2.0)", "Dodge": "floor((fighter+2*rogue+wizard)/2.0)",
    "Block": "floor(CAST(2*fighter+rogue+wizard AS DOUBLE)/6+CAST(2*fighter+rogue+2*wizard AS DOUBLE)/6)",
    "Counter": "floor(CAST(fighter+2*rogue+wizard AS DOUBLE)/6+CAST(2*fighter+2*rogue+wizard AS DOUBLE)/6)",
    "Enemy Dodge Reduction": "floor((fighter+2*rogue+wizard)/3.0)", "Magic Resistance": "floor((2*fighter+rogue+2*wizard)/2.0)",
    "Sneakiness": "greatest(0, floor((2*fighter+4*rogue+3*wizard)*0.75)-20)"}
VIEWS["level_stats_v"] = " UNION ALL ".join(f"SELECT id, '{s}' AS stat, CAST({e} AS BIGINT) AS amount FROM levels_v" for s, e in LEVEL_SQL.items())
query("A17_level_stats", "SELECT * FROM level_stats_v")(lambda spark, sf: derived_stats.level_stats(levels(spark, sf)).select("id", "stat", "amount"))


def monster_bonus(spark, sf):
    names = F.get(F.array(F.lit("Burliness"), F.lit("crushing"), F.lit("Life"), F.lit("slashing")), (F.col("l_linenumber") % 4))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), names.alias("stat"), F.col("l_quantity").alias("amount"), F.expr("l_orderkey * 10 + l_linenumber").alias("position"))


VIEWS["totals_v"] = """
SELECT id, stat, CAST(sum(amount) AS DOUBLE) AS amount FROM (
  SELECT l_suppkey AS id, ['Burliness', 'crushing', 'Life', 'slashing'][l_linenumber % 4 + 1] AS stat, l_quantity AS amount FROM lineitem
  UNION ALL SELECT id, stat, CAST(amount AS DOUBLE) FROM level_stats_v) GROUP BY id, stat"""
query("A18_total_stats", "SELECT id, stat, amount FROM totals_v")(
    lambda spark, sf: derived_stats.total_stats(monster_bonus(spark, sf), levels(spark, sf)).select("id", "stat", "amount"))
query("T09_historical_armour", """SELECT l.id, CAST(floor((2 * fighter + rogue + wizard - 5) / 3.0) AS DOUBLE) + coalesce(d.amount, 0) AS amount FROM levels_v l LEFT JOIN
  (SELECT id, sum(amount) AS amount FROM totals_v WHERE stat IN ('blasting', 'crushing', 'slashing') GROUP BY id) d ON d.id = l.id ORDER BY amount DESC, l.id LIMIT 10""")(
    lambda spark, sf: derived_stats.historical_required_armour(
        levels(spark, sf), derived_stats.total_stats(monster_bonus(spark, sf), levels(spark, sf))).select("id", "amount"))
query("T10_stat_search", "SELECT owner_kind, owner_id, amount FROM modifiers_v WHERE modifier_kind = 'damage' AND source_key = '3'")(
    lambda spark, sf: derived_stats.stat_search(source(spark, sf, "modifiers_v").select(
        "owner_kind", "owner_id", "amount", F.concat_ws(":", "modifier_kind", "source_key").alias("stat"), F.col("position").alias("record")), "damage:3").select(
        "owner_kind", "owner_id", "amount"))


@query("W11_inherit_stats", """
SELECT l_suppkey AS id, s AS stat, arg_max(amount, CAST(near AS HUGEINT) * 100000000000 + place) AS amount,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY min(CAST(near AS HUGEINT) * 100000000000 + place)) AS row_number FROM (
  SELECT l_suppkey, l_linenumber AS s, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS near, l_quantity AS amount,
    l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS place FROM lineitem) GROUP BY l_suppkey, s""")
def inherit_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("stat"), F.col("l_quantity").alias("amount"), "l_returnflag",
        F.expr("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber").alias("position"))
    child, parent = rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag <> 'A'")
    order = Window.partitionBy("id").orderBy("place")
    return derived_stats.inherit_stats(child, parent, ["id"]).select("id", "stat", "amount", F.row_number().over(order).cast("bigint").alias("row_number"))
