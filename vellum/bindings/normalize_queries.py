"""N rows: records derived from the tables, normalised, against SQL that states the expected fields."""

from pyspark.sql import functions as F

from ..functions.records import RULE_LEVELS, attribute, children, element, first_child
from ..normalize import crafts, fields, historical, historical_records, items, modifiers, monsters, spells
from ..operators import linking, quality, spell_linking
from . import views  # noqa: F401
from .registry import query, table


def node(tag, attrs=None, *kids, when=None):
    """A record column builder; attributes are SQL texts over the row."""
    def build(depth):
        inner = [k(depth - 1) for k in kids]
        made = element(tag, {k: F.expr(v) for k, v in (attrs or {}).items()}, None, depth)
        if inner:
            made = made.withField("children", F.filter(F.array(*inner), lambda c: c.isNotNull()))
        return F.when(F.expr(when), made) if when else made

    return build


def rows(spark, sf, root, parent=None, spread=False):
    """One record per order, with the columns that normalisers expect next to it.

    ``spread`` deals the orders out to as many tasks as a shuffle has, for readings that cost
    far more than the few megabytes which make one task of a scan.
    """
    o = table(spark, sf, "orders").withColumn("n", F.col("o_orderkey"))
    if spread:
        o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("row_id"), root(RULE_LEVELS).alias("record"), F.concat(F.lit("src"), F.expr("n % 3")).alias("source_id"),
        F.lit("db.xml").alias("file"), F.expr("cast(n % 5 as int)").alias("precedence"),
        (F.expr(parent) if parent else F.lit(None)).cast("string").alias("parent_name"))


def listed(spark, sf, root, tag, read, *columns):
    """The first declaration of a tag with the given columns, and how many findings it has."""
    kids = children(F.col("record"), tag)
    values, findings = fields.each(kids, read)
    got = rows(spark, sf, root).select("row_id", values().alias("v"), F.size(findings()).alias("finding_count"))
    return got.select("row_id", *[F.get("v", F.lit(0))[c].alias(c) for c in columns], "finding_count")


def _counted(found):
    """Findings by code. A plain explode infers that the array is not empty, and that filter would run all readings once more, below the shuffle that spreads them."""
    return found.select(F.explode_outer("findings").alias("f")).filter("f is not null").groupBy("f.code").agg(F.count(F.lit(1)).alias("n"))


NUM = "CASE n % 4 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN 'bad' WHEN 2 THEN '' END"
SQL_NUM = "CASE WHEN row_id % 4 = 0 THEN cust END"
VIEW = "(SELECT o_orderkey AS row_id, o_custkey AS cust, lower(o_orderpriority) AS word, o_orderstatus AS status FROM orders)"


@query("N04_armour", f"""SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'ring' END AS slot, {SQL_NUM} AS level, CASE WHEN row_id % 2 = 0 THEN 2 END AS randoms,
  CAST(CASE WHEN row_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN row_id % 4 = 0 THEN 0 ELSE 1 END AS INT) AS finding_count FROM {VIEW}""", big="randoms")
def armour(spark, sf):
    root = node("item", {"name": "'a'"}, node("armour", {"type": "CASE WHEN n % 3 = 0 THEN ' Ring' END", "level": NUM, "randoms": "CASE WHEN n % 2 = 0 THEN '2' END"}))
    return listed(spark, sf, root, "armour", items.armour, "slot", "level", "randoms")


@query("N05_weapon", f"""SELECT row_id, row_id % 2 = 0 AS can_target_floor, CASE WHEN row_id % 3 <> 0 THEN 'art/' || word END AS thrown_path,
  CAST(CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def weapon(spark, sf):
    root = node("item", {}, node("weapon", {
        "canTargetFloor": "CASE WHEN n % 2 = 0 THEN '1' END", "cantargetfloor": "CASE WHEN n % 2 = 1 THEN 'false' END",
        "thrown": "CASE WHEN n % 3 = 0 THEN '../x' ELSE './art/' || lower(o_orderpriority) END", "crushing": "'3'"}))
    return listed(spark, sf, root, "weapon", items.weapon, "can_target_floor", "thrown_path")


@query("N06_macguffin", f"""SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'zap ' || cust END AS spell_key, CASE WHEN row_id % 2 = 0 THEN 'Zap  ' || cust END AS spell_name,
  CASE WHEN row_id % 3 = 0 THEN word END AS item_class_name, CASE WHEN row_id % 5 = 0 THEN TRUE END AS consumable,
  CAST(row_id % 2 + CASE WHEN row_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN row_id % 5 = 1 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def macguffin(spark, sf):
    root = node("item", {}, node("macguffin", {
        "spell": "CASE WHEN n % 2 = 0 THEN 'Zap  ' || o_custkey ELSE ' ' END", "item_class_name": "CASE n % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN '' END",
        "consumable": "CASE n % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'maybe' END"}))
    return listed(spark, sf, root, "macguffin", items.macguffin, "spell_key", "spell_name", "item_class_name", "consumable")


@query("N07_toolkit", f"""SELECT row_id, word AS tag, CASE WHEN row_id % 2 = 0 THEN 1 END AS num_slots, CASE WHEN row_id % 3 = 0 THEN 'art/m.png' END AS missing_path,
  CAST(CASE WHEN row_id % 4 = 0 THEN 2 ELSE 1 END AS INT) AS slots, CAST(CASE WHEN row_id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END
    + 1 + CASE WHEN row_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""", big="num_slots")
def toolkit(spark, sf):
    """Slot 1 is incomplete always; slot 2 is whole where it is given, and beyond a slot count of one."""
    second = {f"slot2_{k}": "CASE WHEN n % 4 = 0 THEN '5' END" for k in items.CORNERS}
    root = node("item", {}, node("toolkit", {
        "tag": "' ' || lower(o_orderpriority)", "numslots": "CASE WHEN n % 2 = 0 THEN '1' END", "missing": "CASE WHEN n % 3 = 0 THEN 'art/m.png' END", "slot1_x1": "'3'", **second}))
    values, findings = fields.each(children(F.col("record"), "toolkit"), items.toolkit)
    got = rows(spark, sf, root).select("row_id", F.get(values(), F.lit(0)).alias("v"), F.size(findings()).alias("finding_count"))
    return got.select("row_id", "v.tag", "v.num_slots", "v.missing_path", F.size("v.slot_bounds").alias("slots"), "finding_count")


@query("N08_recoveries", f"""SELECT row_id, 'life' AS resource, {SQL_NUM} AS amount, CAST(CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS flag_count FROM {VIEW} WHERE row_id % 4 <> 3
UNION ALL SELECT row_id, 'mana', 7, CAST(CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END AS INT) FROM {VIEW} WHERE row_id % 3 = 0""")
def recoveries(spark, sf):
    root = node("item", {}, node("food", {"hp": NUM, "mp": "CASE WHEN n % 3 = 0 THEN '7' END", "meat": "CASE WHEN n % 2 = 0 THEN '1' END"}))
    values, _ = items.recoveries(F.col("record"))
    return rows(spark, sf, root).select("row_id", F.explode(values()).alias("r")).select("row_id", "r.resource", "r.amount", F.size("r.source_flags").alias("flag_count"))


@query("N09_charge_ranges", f"""SELECT row_id, CASE WHEN cust <= 500 THEN cust END AS minimum, CASE WHEN cust <= 500 THEN 500 END AS maximum,
  CAST(CASE WHEN cust > 500 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""", big="maximum")
def charge_ranges(spark, sf):
    root = node("item", {}, node("wand", {"mincharge": "cast(o_custkey AS string)", "maxcharge": "'500'", "spell": "'Zap'"}))
    return listed(spark, sf, root, "wand", items.charge_range, "minimum", "maximum")


@query("N10_traps", f"""SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'once' END AS activation, {SQL_NUM} AS level, row_id % 2 = 0 AS targets_caster,
  word AS origin_mount, CAST(CASE WHEN row_id % 3 = 2 THEN 1 ELSE 0 END + CASE WHEN row_id % 4 = 1 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def traps(spark, sf):
    root = node("item", {}, node("trap", {
        "trigger": "CASE n % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'once' ELSE 'never' END", "level": NUM, "targetIsCaster": "cast(1 - n % 2 AS string)",
        "originMount": "lower(o_orderpriority)", "casts": "'Boom'"}))
    return listed(spark, sf, root, "trap", items.trap, "activation", "level", "targets_caster", "origin_mount")


query("N11_artifacts", f"SELECT row_id, {SQL_NUM} AS quality, CAST(CASE WHEN row_id % 4 = 1 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}")(
    lambda spark, sf: listed(spark, sf, node("item", {}, node("artifact", {"quality": NUM})), "artifact", items.artifact, "quality"))
query("N12_gem_markers", f"SELECT row_id, 'unknown_attribute' AS code, 'Unsupported gem attribute cut was preserved only as a diagnostic.' AS message FROM {VIEW} WHERE row_id % 2 = 0 UNION ALL SELECT row_id, 'unknown_element', 'Unsupported <facet> element was preserved only as a diagnostic.' FROM {VIEW} WHERE row_id % 3 = 0")(
    lambda spark, sf: rows(spark, sf, node("item", {}, node("gem", {"cut": "CASE WHEN n % 2 = 0 THEN 'x' END"}, node("facet", when="n % 3 = 0")))).select(
        "row_id", F.explode(items.gem_findings(F.col("record"))).alias("f")).select("row_id", "f.code", "f.message"))

ITEM_TRIGGERS = node(
    "item", {}, node("targetHitEffectBuff", {"name": "'Burn ' || o_custkey", "percent": "cast(n % 120 AS string)"}, when="n % 2 = 0"),
    node("effect", {"type": "CASE n % 3 WHEN 0 THEN 'trigger' WHEN 1 THEN 'dot' ELSE 'other' END", "spell": "'Wave'", "amount": "'4'", "resistable": "'0'"}),
    node("wand", {"spell": "'Zap'"}, when="n % 5 = 0"), node("potion", {}, when="n % 7 = 0"))


@query("N13_spell_triggers", f"""SELECT row_id, 'melee-target' AS kind, 'burn ' || cust AS spell_key, CASE WHEN row_id % 120 <= 100 THEN row_id % 120 ELSE 0 END AS chance, 0 AS delay, 0 AS duration, FALSE AS unresistable FROM {VIEW} WHERE row_id % 2 = 0
UNION ALL SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'trigger-once' ELSE 'trigger-repeat' END, 'wave', NULL, CASE WHEN row_id % 3 = 0 THEN 4 ELSE 0 END, CASE WHEN row_id % 3 = 1 THEN 4 ELSE 0 END, TRUE FROM {VIEW} WHERE row_id % 3 <> 2""", big="delay duration")
def spell_triggers(spark, sf):
    got = rows(spark, sf, ITEM_TRIGGERS).select("row_id", F.explode(modifiers.spell_triggers(F.col("record"), "ability")).alias("t"))
    return got.select("row_id", "t.kind", "t.spell_key", "t.chance", "t.delay", "t.duration", "t.unresistable")


query("N14_item_triggers", f"""SELECT row_id, CAST(CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN row_id % 3 <> 2 THEN 1 ELSE 0 END + CASE WHEN row_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS trigger_count,
  CASE WHEN row_id % 5 = 0 THEN 'zapped' WHEN row_id % 2 = 0 THEN 'melee-target' WHEN row_id % 3 = 0 THEN 'trigger-once' WHEN row_id % 3 = 1 THEN 'trigger-repeat' END AS first_kind FROM {VIEW}""")(
    lambda spark, sf: rows(spark, sf, ITEM_TRIGGERS).select("row_id", modifiers.spell_triggers(F.col("record"), "item").alias("t")).select(
        "row_id", F.size("t").alias("trigger_count"), F.get("t", F.lit(0))["kind"].alias("first_kind")))
query("N13_trigger_findings", f"""SELECT row_id, 'missing_trigger_spell' AS code FROM {VIEW} WHERE row_id % 7 = 0 UNION ALL SELECT row_id, 'invalid_number' FROM {VIEW} WHERE row_id % 2 = 0 AND row_id % 120 > 100""")(
    lambda spark, sf: rows(spark, sf, ITEM_TRIGGERS).select("row_id", F.explode(modifiers.trigger_findings(F.col("record"), "item")).alias("f")).select("row_id", "f.code"))

MODS = node(
    "monster", {}, node("damage", {"crushing": "cast(o_custkey AS string)", "odd": "CASE WHEN n % 2 = 0 THEN '1' END"}),
    node("damage", {"crushing": "CASE WHEN n % 3 = 0 THEN '9' END"}), node("resistances", {"toxic": "'x'"}), node("primaryBuff", {"id": "'4'", "amount": "'.5'"}),
    node("secondarybuff", {"amount": "'1'"}))
MOD_SQL = f"""SELECT row_id, 'damage' AS kind, 'crushing' AS source_key, CAST(CASE WHEN row_id % 3 = 0 THEN 9 ELSE cust END AS DOUBLE) AS amount FROM {VIEW}
UNION ALL SELECT row_id, 'resistance', 'toxic', 0 FROM {VIEW} UNION ALL SELECT row_id, 'primary', '4', 0.5 FROM {VIEW}"""
query("N15_stat_modifiers", MOD_SQL)(
    lambda spark, sf: rows(spark, sf, MODS).select("row_id", F.explode(modifiers.stat_modifiers(F.col("record"), "monster")).alias("m")).select("row_id", "m.kind", "m.source_key", "m.amount"))
query("N15_modifier_findings", f"""SELECT row_id, code, count(*) AS n FROM (SELECT row_id, 'unknown_monster_modifier' AS code FROM {VIEW} WHERE row_id % 2 = 0 UNION ALL SELECT row_id, 'invalid_number' FROM {VIEW}
  UNION ALL SELECT row_id, 'missing_monster_modifier_key' FROM {VIEW} UNION ALL SELECT row_id, 'duplicate_monster_modifier' FROM {VIEW} WHERE row_id % 3 = 0) GROUP BY ALL""")(
    lambda spark, sf: rows(spark, sf, MODS).select("row_id", F.explode(modifiers.modifier_findings(F.col("record"), "monster")).alias("f")).groupBy("row_id", "f.code").agg(
        F.count(F.lit(1)).alias("n")))
query("N16_weapon_damage", f"SELECT row_id, 'slashing' AS source_key, CAST(cust AS DOUBLE) AS amount FROM {VIEW} UNION ALL SELECT row_id, 'toxic', 2 FROM {VIEW}")(
    lambda spark, sf: rows(spark, sf, node("item", {}, node("weapon", {"slashing": "cast(o_custkey AS string)", "hit": "'x'"}), node("damagebuff", {"toxic": "'2'"}))).select(
        "row_id", F.explode(modifiers.stat_modifiers(F.col("record"), "item")).alias("m")).select("row_id", "m.source_key", "m.amount"))

RECIPE = node("craft", {"name": "CASE WHEN n % 2 = 0 THEN 'Brew ' || o_custkey END", "hidden": "CASE WHEN n % 3 = 0 THEN '1' END"}, node("tool", {"tag": "lower(o_orderpriority)"}),
              node("input", {"name": "'Ore'", "amount": "CASE WHEN n % 4 = 0 THEN '0' ELSE '3' END"}), node("input", {}),
              node("output", {"name": "'Part ' || o_custkey", "skill": "cast(n % 6 AS string)"}), node("output", {"name": "'Slag'", "skill": "'2'"}))


@query("N17_recipes", f"""SELECT CASE WHEN row_id % 2 = 0 THEN 'recipe:brew ' || cust ELSE 'recipe:part ' || cust || ' recipe' END AS id, word AS tool, row_id % 3 = 0 AS hidden,
  greatest(row_id % 6, 2) AS skill_level, CASE WHEN row_id % 4 = 0 THEN 1 ELSE 3 END AS amount, CAST(CASE WHEN row_id % 4 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""", big="amount")
def recipes(spark, sf):
    got = crafts.parse_recipes(rows(spark, sf, RECIPE))
    return got.select("id", "tool", "hidden", "skill_level", F.get("inputs", F.lit(0))["amount"].alias("amount"), F.size("findings").alias("finding_count"))


ENCRUST = node("encrust", {"name": "'Coat ' || n", "tool": "'alt'"}, node("skill", {"level": "cast(n % 4 AS string)"}), node("slot", {"type": "' Head'"}), node("slot", {"type": "lower(o_orderpriority)"}),
               node("slot", {"type": "'head'"}), node("instability", {"amount": "cast(-n % 9 AS string)"}), node("power", {"name": "'p'", "chance": "CASE WHEN n % 2 = 0 THEN '.5' ELSE '3' END"}),
               node("encrustwith", {"name": "'Shiny'"}), node("odd", when="n % 5 = 0"))


@query("N18_encrustments", f"""SELECT 'encrustment:coat ' || row_id AS id, 'alt' AS tool, row_id % 4 AS skill_level, array_to_string(list_sort(['head', word]), ',') AS slots, -(row_id % 9) AS instability,
  CASE WHEN row_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS chance, CAST(row_id % 2 + CASE WHEN row_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def encrustments(spark, sf):
    got = crafts.parse_encrustments(rows(spark, sf, ENCRUST))
    return got.select("id", "tool", "skill_level", F.array_join("slots", ",").alias("slots"), "instability", F.get("powers", F.lit(0))["chance"].alias("chance"),
                      F.size("findings").alias("finding_count"))


UNSTABLE = node("unstableEffect", {"name": "CASE WHEN n % 3 <> 0 THEN 'Fx ' || n END", "spell": "CASE WHEN n % 5 <> 0 THEN 'Boom' END"})
query("N19_instability", f"SELECT 'Fx ' || row_id AS name, 'boom' AS spell_key FROM {VIEW} WHERE row_id % 3 <> 0 AND row_id % 5 <> 0")(
    lambda spark, sf: crafts.parse_instability(rows(spark, sf, UNSTABLE)).select("name", "spell_key"))
query("N19_instability_findings", f"SELECT CASE WHEN row_id % 3 = 0 THEN 'missing_instability_effect_name' ELSE 'missing_instability_effect_spell' END AS code, count(*) AS n FROM {VIEW} WHERE row_id % 3 = 0 OR row_id % 5 = 0 GROUP BY 1")(
    lambda spark, sf: crafts.instability_findings(rows(spark, sf, UNSTABLE)).groupBy("code").agg(F.count(F.lit(1)).alias("n")))

SKILL = node("skill", {"name": "'Skill ' || n", "type": "lower(o_orderpriority)"}, node("loadout", {"subtype": "CASE WHEN n % 2 = 0 THEN 'Pick  ' || o_custkey END", "type": "'tool'", "always": "'1'"}),
             node("flags", {"b": "'1'", "a": "'0'"}), node("tag", {"name": "'late'", "level": "'9'"}), node("tag", {"name": "'early'", "level": "cast(n % 5 AS string)"}), node("tag", {}, when="n % 3 = 0"))


@query("N20_skills", f"""SELECT 'skill:skill ' || row_id AS id, word AS archetype, CASE WHEN row_id % 2 = 0 THEN 'pick ' || cust END AS item_key, 'a=0,b=1' AS flags, 'early' AS first_tag,
  CAST(CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def skills(spark, sf):
    got = crafts.parse_skills(rows(spark, sf, SKILL))
    flags = F.array_join(F.transform("source_flags", lambda f: F.concat_ws("=", f["source_key"], f["value"])), ",")
    return got.select("id", "archetype", F.get("loadouts", F.lit(0))["item_key"].alias("item_key"), flags.alias("flags"), F.get("progression_tags", F.lit(0))["name"].alias("first_tag"),
                      F.size("findings").alias("finding_count"))


ABILITY = node("ability", {"name": "'Able ' || n", "skill": "CASE WHEN n % 4 <> 0 THEN 'Skill  ' || o_custkey END", "level": "cast(n % 6 AS string)", "startSkill": "CASE WHEN n % 2 = 0 THEN 'true' END"},
               node("recoverybuff", {"amount": "'3'"}), node("recoverybuff", {"amount": "'-1.5'"}), node("zorkmidbuff", {}), node("dodgeBuff", {"spell": "'Zip'"}))


@query("N21_abilities", f"""SELECT 'ability:able ' || row_id AS id, 'skill ' || cust AS skill_key, row_id % 6 AS level, row_id % 2 = 0 AS start_skill, '-1.5,3.0' AS amounts, 'zip' AS spell_keys,
  1 AS finding_count FROM {VIEW} WHERE row_id % 4 <> 0""")
def abilities(spark, sf):
    got = crafts.parse_abilities(rows(spark, sf, ABILITY))
    return got.select("id", "skill_key", "level", "start_skill", F.array_join(F.transform("recovery_amounts", lambda a: a.cast("string")), ",").alias("amounts"),
                      F.array_join("spell_keys", ",").alias("spell_keys"), F.size("findings").alias("finding_count"))


query("N21_ability_errors", f"SELECT 'ability:able ' || row_id AS entity_id, 'missing_required_reference' AS code FROM {VIEW} WHERE row_id % 4 = 0")(
    lambda spark, sf: crafts.ability_errors(rows(spark, sf, ABILITY)).select("entity_id", "code"))

SPELL = node(
    "spell", {"name": "'Cast ' || n", "type": "CASE WHEN n % 2 = 0 THEN 'template' ELSE 'self' END", "radius": NUM, "attack": "CASE n % 3 WHEN 0 THEN '1' WHEN 1 THEN 'true' END",
              "templateID": "CASE WHEN n % 2 = 0 THEN 'T' || o_custkey END", "mine": "CASE WHEN n % 5 = 0 THEN '1' END", "mineradius": "CASE WHEN n % 5 = 0 THEN '2' END",
              "consumeItemType": "CASE n % 7 WHEN 0 THEN 'booze' WHEN 1 THEN '' END"},
    node("description", {"text": "lower(o_orderpriority)"}), node("requirements", {"mp": "cast(o_custkey AS string)", "level": "'200'"}), node("requirements", {"shield": "'1'"}),
    node("requirements", {"odd": "'1'"}, when="n % 11 = 0"))


@query("N22_spells", f"""SELECT 'spell:cast ' || row_id AS id, word AS description, CASE WHEN row_id % 2 = 0 THEN 'template' ELSE 'self' END AS spell_type, {SQL_NUM} AS source_radius,
  CASE WHEN row_id % 3 = 0 THEN TRUE END AS melee_attack, CASE WHEN row_id % 2 = 0 THEN 't' || cust END AS template_key, CASE WHEN row_id % 5 = 0 THEN 2 END AS mine_radius FROM {VIEW}""", big="mine_radius")
def spell_roots(spark, sf):
    got = spells.parse_spells(rows(spark, sf, SPELL))
    return got.select("id", "description", "spell_type", "source_radius", "melee_attack", "template_key", F.col("mine.radius").alias("mine_radius"))


@query("N23_consumption_and_mine", f"""SELECT row_id, CASE WHEN row_id % 7 = 0 THEN 'booze' END AS item_type, row_id % 7 IN (0, 1) AS consumes, CASE WHEN row_id % 5 = 0 THEN TRUE END AS mine_enabled,
  CAST(CASE WHEN row_id % 7 = 1 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def consumption(spark, sf):
    part, mined = spells.item_consumption(F.col("record")), spells.mine(F.col("record"))
    got = rows(spark, sf, SPELL).select(
        "row_id", part.struct().alias("c"), mined.struct().alias("m"), spells.any_of(F.col("record"), spells.CONSUME_ATTRIBUTES).alias("consumes"),
        F.size(fields.present(part.findings)).alias("finding_count"))
    return got.select("row_id", "c.item_type", "consumes", F.col("m.enabled").alias("mine_enabled"), "finding_count")


@query("N24_requirements", f"""SELECT row_id, 1 AS mana, 1 AS shields, CAST(cust AS DOUBLE) AS base, CAST(1 + CASE WHEN row_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}""")
def requirements(spark, sf):
    arrays, findings = spells.requirements(F.col("record"))
    got = rows(spark, sf, SPELL).select("row_id", *[fields.built(v).alias(k) for k, v in arrays.items()], F.size(findings()).alias("finding_count"))
    return got.select("row_id", F.size("mana_costs").alias("mana"), F.size("shield_requirements").alias("shields"), F.get("mana_costs", F.lit(0))["base"].alias("base"), "finding_count")


query("N25_frames", f"SELECT row_id, 'fx/' || word || '.png' AS sprite_path, {SQL_NUM} AS frame_count, row_id % 2 = 0 AS centered, CAST(CASE WHEN row_id % 4 = 1 THEN 1 ELSE 0 END AS INT) AS finding_count FROM {VIEW}")(
    lambda spark, sf: listed(spark, sf, node("spell", {}, node("anim", {"sprite": "'fx/' || lower(o_orderpriority) || '.png'", "num": NUM, "centereffect": "cast(1 - n % 2 AS string)"})), "anim",
                             spells.frames("anim", "animation"), "sprite_path", "frame_count", "centered"))

BUFF = node("spell", {}, node(
    "buff", {"time": NUM, "usetimer": "'1'", "self": "'1'", "bad": "CASE WHEN n % 2 = 0 THEN 'no' END", "tag": "lower(o_orderpriority)"},
    node("halo", {"name": "'h.png'", "frameRate": "'5'", "framerate": "CASE WHEN n % 3 = 0 THEN '6' END"}), node("polymorph", {"name": "CASE WHEN n % 5 = 0 THEN ' ' ELSE 'Mob ' || o_custkey END"}),
    node("payback", {"paybackF": "'.5'"}), node("targetHitEffectBuff", {"name": "'Zap'", "percentage": "'30'", "after": "'1'"}), node("dodgebuff", {"percentage": "'101'"}),
    node("effect", {"type": "'heal'", "amount": "'4'", "amountF": "'0.5'"}), node("primarybuff", {"id": "'2'", "amount": "'1'"}), node("sightbuff", {"amount": "'2'"}), node("ai", {"hint": "'flee'"})))


def _buff(spark, sf):
    values, _ = fields.each(children(F.col("record"), "buff"), spells.buff)
    return rows(spark, sf, BUFF).select("row_id", F.get(values(), F.lit(0)).alias("b"))


def _buff_findings(spark, sf):
    """Findings alone: the values of a buff take as long to plan and are not asked for."""
    _, findings = fields.each(children(F.col("record"), "buff"), spells.buff)
    return rows(spark, sf, BUFF, spread=True).select("row_id", findings().alias("findings"))


query("N26_buffs", f"""SELECT row_id, {SQL_NUM} AS duration, 1 AS timer_mode, TRUE AS affects_self, word AS tag, 'heal' AS effect_type, '2' AS modifier_key FROM {VIEW}""", big="timer_mode")(
    lambda spark, sf: _buff(spark, sf).select("row_id", "b.duration", "b.timer_mode", "b.affects_self", F.get("b.source_flags", F.lit(0))["value"].alias("tag"),
                                              F.get("b.effects", F.lit(0))["type"].alias("effect_type"), F.get("b.modifiers", F.lit(0))["source_key"].alias("modifier_key")))
query("N27_buff_declarations", f"""SELECT row_id, 5 AS frame_rate, CASE WHEN row_id % 5 <> 0 THEN 'mob ' || cust END AS monster_key, 0.5::DOUBLE AS factor, 2.0::DOUBLE AS sight FROM {VIEW}""", big="frame_rate")(
    lambda spark, sf: _buff(spark, sf).select("row_id", F.get("b.halos", F.lit(0))["frame_rate"].alias("frame_rate"), F.get("b.polymorphs", F.lit(0))["monster_key"].alias("monster_key"),
                                              F.get("b.paybacks", F.lit(0))["factor"].alias("factor"), F.get("b.sight_modifiers", F.lit(0))["amount"].alias("sight")))
query("N27_buff_findings", f"""SELECT code, count(*) AS n FROM (SELECT unnest(['missing_spell_buff_payback_secondary_scale', 'missing_spell_buff_hook_target', 'invalid_number']) AS code FROM {VIEW}
  UNION ALL SELECT 'invalid_number' FROM {VIEW} WHERE row_id % 4 = 1 UNION ALL SELECT 'invalid_boolean' FROM {VIEW} WHERE row_id % 2 = 0
  UNION ALL SELECT 'conflicting_spell_buff_halo_aliases' FROM {VIEW} WHERE row_id % 3 = 0 UNION ALL SELECT 'missing_spell_buff_polymorph_target' FROM {VIEW} WHERE row_id % 5 = 0) GROUP BY code""")(
    lambda spark, sf: _counted(_buff_findings(spark, sf)))
query("N28_ai_hints", f"SELECT row_id, CASE WHEN row_id % 2 = 0 THEN word END AS hint, CAST(row_id % 2 AS INT) AS finding_count FROM {VIEW}")(
    lambda spark, sf: listed(spark, sf, node("spell", {}, node("ai", {"hint": "CASE WHEN n % 2 = 0 THEN lower(o_orderpriority) ELSE ' ' END"})), "ai",
                             spells.ai_hint(F.lit("Spell"), {"scope": '"spell"'}), "hint"))
query("N29_event_hooks", f"SELECT row_id, 'target-hit' AS kind, 'zap' AS spell_key, 30 AS chance, '1' AS after FROM {VIEW}", big="chance")(
    lambda spark, sf: _buff(spark, sf).select("row_id", F.explode("b.event_hooks").alias("h")).select("row_id", "h.kind", "h.spell_key", "h.chance", "h.after"))

EFFECTS = node(
    "spell", {}, node("effect", {"type": "'trigger'", "spell": "'Zap'", "amount": "'3'", "requirebuffontrigger": "'1'", "requirebuffontriggername": "CASE WHEN n % 2 = 0 THEN 'Ward ' || o_custkey END",
                                 "percentage": "CASE WHEN n % 3 = 0 THEN '101' ELSE '40' END", "taxa": "' mob '"}),
    node("effect", {"type": "'damage'", "crushing": "cast(o_custkey AS string)", "toxicF": "'.5'", "voltaic": "CASE WHEN n % 5 = 0 THEN ' ' END", "primaryscale": "'2'", "sprite": "'s.png'", "midas": "'1'"}),
    node("effect", {"type": "'summon'", "monsterType": "'Mob ' || o_custkey"}), node("effect", {"type": "'spawn'", "itemName": "'Egg'", "itemname": "CASE WHEN n % 7 = 0 THEN 'Yolk' END"}),
    node("effect", {"type": "'removebuffbyname'", "name": "'Ward'"}), node("effect", {"type": "'spawnitemfromlist'"}, node("option", {"name": "'Egg'", "amount": "CASE WHEN n % 2 = 0 THEN '2' ELSE '0' END"}),
                                                                            node("option", {})),
    node("effect", {"type": "'create'", "objectSprite": "'o.png'", "buffTag": "'t'", "regengfx": "'1'"}))


def _effects(spark, sf):
    values, _ = spells.spell_effects(F.col("record"))
    return rows(spark, sf, EFFECTS).select("row_id", values().alias("effects"))


def _effect_findings(spark, sf):
    _, findings = spells.spell_effects(F.col("record"))
    return rows(spark, sf, EFFECTS, spread=True).select("row_id", findings().alias("findings"))


def _effect(spark, sf, kind):
    return _effects(spark, sf).select("row_id", F.explode("effects").alias("e")).filter(F.col("e.type") == kind)


query("N30_effects", f"""SELECT row_id, CAST(pos - 1 AS INT) AS position, type FROM (SELECT row_id, unnest(['create', 'damage', 'removebuffbyname', 'spawn', 'spawnitemfromlist', 'summon', 'trigger']) AS type, generate_subscripts(['create', 'damage', 'removebuffbyname', 'spawn', 'spawnitemfromlist', 'summon', 'trigger'], 1) AS pos FROM {VIEW})""")(
    lambda spark, sf: _effects(spark, sf).select("row_id", F.posexplode("effects").alias("position", "e")).select("row_id", "position", "e.type"))
query("N31_effect_targets", f"""SELECT row_id, 'summon' AS type, NULL AS item_key, 'mob ' || cust AS monster_key, NULL AS removed_spell_key FROM {VIEW} UNION ALL SELECT row_id, 'spawn', CASE WHEN row_id % 7 = 0 THEN 'yolk' ELSE 'egg' END, NULL, NULL FROM {VIEW}
UNION ALL SELECT row_id, 'removebuffbyname', NULL, NULL, 'ward' FROM {VIEW}""")(
    lambda spark, sf: _effects(spark, sf).select("row_id", F.explode("effects").alias("e")).filter("e.type in ('summon', 'spawn', 'removebuffbyname')").select(
        "row_id", "e.type", "e.targets.item_key", "e.targets.monster_key", "e.targets.removed_spell_key"))
query("N32_effect_damage", f"""SELECT row_id, 'crushing' AS source_key, CAST(cust AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS factor, 2 AS primary_stat FROM {VIEW} UNION ALL SELECT row_id, 'toxic', NULL, 0.5, 2 FROM {VIEW}
UNION ALL SELECT row_id, 'voltaic', NULL, NULL, 2 FROM {VIEW} WHERE row_id % 5 = 0""", big="primary_stat")(
    lambda spark, sf: _effect(spark, sf, "damage").select("row_id", F.explode("e.damage").alias("d"), F.col("e.scaling.primary_stat").alias("primary_stat")).select(
        "row_id", "d.source_key", "d.amount", "d.factor", "primary_stat"))
query("N33_effect_presentation", f"SELECT row_id, 'damage' AS type, 's.png' AS sprite_path, CAST(NULL AS VARCHAR) AS created, CAST(NULL AS VARCHAR) AS buff_tag FROM {VIEW} UNION ALL SELECT row_id, 'create', NULL, 'o.png', 't' FROM {VIEW}")(
    lambda spark, sf: _effects(spark, sf).select("row_id", F.explode("effects").alias("e")).filter("e.type in ('damage', 'create')").select(
        "row_id", "e.type", "e.presentation.sprite_path", F.col("e.created_object_sprite").alias("created"), "e.buff_tag"))
query("N34_effect_controls", f"SELECT row_id, CASE WHEN row_id % 3 <> 0 THEN 40 END AS chance_percent, 'mob' AS taxonomy, CAST(NULL AS BOOLEAN) AS midas FROM {VIEW}", big="chance_percent")(
    lambda spark, sf: _effect(spark, sf, "trigger").select("row_id", "e.controls.chance_percent", "e.controls.taxonomy", "e.controls.midas"))
query("N35_effect_conditions", f"SELECT row_id, TRUE AS required_enabled, CASE WHEN row_id % 2 = 0 THEN 'ward ' || cust END AS required_spell_key, CAST(NULL AS VARCHAR) AS forbidden_spell_key FROM {VIEW}")(
    lambda spark, sf: _effect(spark, sf, "trigger").select("row_id", "e.conditions.required_enabled", "e.conditions.required_spell_key", "e.conditions.forbidden_spell_key"))
query("N36_effect_options", f"SELECT row_id, 0 AS option_index, 'egg' AS target_key, CASE WHEN row_id % 2 = 0 THEN 2 END AS amount FROM {VIEW} UNION ALL SELECT row_id, 1, NULL, NULL FROM {VIEW}", big="amount")(
    lambda spark, sf: _effect(spark, sf, "spawnitemfromlist").select("row_id", F.posexplode("e.options").alias("option_index", "o")).select("row_id", "option_index", "o.target_key", "o.amount"))
def linked_spells(spark, sf):
    """References of parsed effects and buffs, resolved against names of which some are missing."""
    effects, _ = spells.spell_effects(F.col("record"))
    buffs, _ = fields.each(children(F.col("record"), "buff"), spells.buff)
    head = [F.concat(F.lit("spell:"), F.col("row_id").cast("string")).alias("id"), F.concat(F.lit("S"), F.col("row_id").cast("string")).alias("name")]
    mobs = table(spark, sf, "customer")
    known = lambda kind, key, df: df.select(F.lit(kind).alias("kind"), key.alias("alias"), F.concat(F.lit(kind + ":"), key).alias("target_id"))
    aliases = known("monster", F.concat(F.lit("mob "), "c_custkey"), mobs.filter("c_custkey % 3 <> 0")).unionByName(
        known("spell", F.concat(F.lit("ward "), "c_custkey"), mobs.filter("c_custkey % 4 <> 0"))).unionByName(
        known("spell", F.lit("zap"), spark.range(1))).unionByName(known("item", F.lit("egg"), spark.range(1)))
    from_effects = spell_linking.link_spells(rows(spark, sf, EFFECTS).select(*head, effects().alias("effects")), aliases)
    return from_effects.unionByName(spell_linking.link_spells(rows(spark, sf, BUFF).select(*head, buffs().alias("buffs")), aliases))


SPELL_LINKS = f"""
SELECT 'spell:' || row_id AS owner_id, path, buff, effect, "inner", target_kind, label, CASE
    WHEN label = 'Zap' THEN 'spell:zap' WHEN label = 'Egg' THEN 'item:egg' WHEN label LIKE 'Mob %' AND cust % 3 <> 0 THEN 'monster:mob ' || cust
    WHEN label LIKE 'Ward %' AND cust % 4 <> 0 THEN 'spell:ward ' || cust END AS target_id, path = 'item-target' AS silent
FROM (
    SELECT row_id, cust, unnest(['removed-buff', 'item-target', 'option', 'monster-target', 'effect-spell', 'event-hook']) AS path, unnest([NULL, NULL, NULL, NULL, NULL, 0]) AS buff,
      unnest([2, 3, 4, 5, 6, NULL]) AS effect, unnest([NULL, NULL, 0, NULL, NULL, 0]) AS "inner", unnest(['spell', 'item', 'item', 'monster', 'spell', 'spell']) AS target_kind,
      unnest(['Ward', CASE WHEN row_id % 7 = 0 THEN 'Yolk' ELSE 'Egg' END, 'Egg', 'Mob ' || cust, 'Zap', 'Zap']) AS label FROM {VIEW}
    UNION ALL SELECT row_id, cust, 'required-buff', NULL, 6, NULL, 'spell', 'Ward ' || cust FROM {VIEW} WHERE row_id % 2 = 0
    UNION ALL SELECT row_id, cust, 'polymorph', 0, NULL, 0, 'monster', 'Mob ' || cust FROM {VIEW} WHERE row_id % 5 <> 0)"""
query("J07_link_spells", SPELL_LINKS)(
    lambda spark, sf: linked_spells(spark, sf).select("owner_id", "path", "buff", "effect", "inner", "target_kind", "label", "target_id", "silent"))
query("J07_dangling_spells", f"""SELECT owner_id, target_kind, label, 'S' || substr(owner_id, 7) || ' references an unknown ' || target_kind || ': ' || label AS message
FROM ({SPELL_LINKS}) WHERE target_id IS NULL AND NOT silent""")(
    lambda spark, sf: linking.dangling(linked_spells(spark, sf)).select("owner_id", "target_kind", "label", "message"))
query("N36_effect_findings", f"""SELECT code, count(*) AS n FROM (SELECT unnest(['missing_spell_effect_option_target', 'unknown_attribute']) AS code FROM {VIEW}
  UNION ALL SELECT 'incomplete_spell_effect_buff_condition' FROM {VIEW} WHERE row_id % 2 = 1 UNION ALL SELECT 'invalid_number' FROM {VIEW} WHERE row_id % 3 = 0 UNION ALL SELECT 'invalid_number' FROM {VIEW} WHERE row_id % 2 = 1
  UNION ALL SELECT 'invalid_number' FROM {VIEW} WHERE row_id % 5 = 0 UNION ALL SELECT 'conflicting_spell_effect_item_target_aliases' FROM {VIEW} WHERE row_id % 7 = 0) GROUP BY code""")(
    lambda spark, sf: _counted(_effect_findings(spark, sf)))

MONSTER = node(
    "monster", {"name": "'Mob ' || n", "level": "CASE WHEN n % 2 = 0 THEN cast(n % 12 AS string) END", "taxa": "lower(o_orderpriority)", "special": "CASE WHEN n % 3 = 0 THEN '1' END"},
    node("stats", {"numFig": "'2'", "numWiz": "'x'", "xpValue": "cast(o_custkey AS string)"}), node("onHit", {"spell": "'Bite'", "onechancein": "cast(1 + n % 7 AS string)"}), node("spell", {"name": "'Fire'"}),
    node("ai", {"spellpercentage": "'25'", "invisible": "'1'"}), node("dash", {"chance": "'30'", "missspell": "'Oops'"}), node("drop", {"name": "'Egg'", "percent": "cast(n % 150 AS string)"}),
    node("drop", {"type": "'gem'"}), node("palette", {"name": "'P.pal'", "tint": "'40'"}), node("damage", {"crushing": "'2'"}), node("idleSprite", {"down": "'art/' || n || '.xml'"}))


@query("N37_monsters", f"""SELECT 'monster:mob ' || row_id AS id, word AS taxonomy, CASE WHEN row_id % 2 = 0 THEN row_id % 12 ELSE 0 END AS level, CASE WHEN row_id % 2 = 0 THEN row_id % 12 + 1 END AS depth, row_id % 3 = 0 AS special, 2 AS fighter, 0 AS wizard, cust AS experience_value,
  CASE WHEN row_id % 4 = 0 THEN 'mob  ' || cust END AS inherits_name, CASE WHEN row_id % 4 = 0 THEN 'mob ' || cust END AS inherits_key, CAST(floor(100.0 / (1 + row_id % 7) + 0.5) AS BIGINT) AS on_hit_chance, 'on-hit,cast-when-aware,dash-miss' AS trigger_kinds,
  CASE WHEN row_id % 150 <= 100 THEN row_id % 150 ELSE 100 END AS drop_chance, 'P.pal' AS palette_name, 40 AS palette_tint FROM {VIEW}""", big="fighter wizard palette_tint")
def monster_roots(spark, sf):
    got = monsters.parse_monsters(rows(spark, sf, MONSTER, "CASE WHEN n % 4 = 0 THEN 'mob  ' || o_custkey END"))
    return got.select("id", "taxonomy", "level", "depth", "special", "fighter", "wizard", "experience_value", "inherits_name", "inherits_key",
                      F.get("triggers", F.lit(0))["chance"].alias("on_hit_chance"), F.array_join(F.transform("triggers", lambda t: t["kind"]), ",").alias("trigger_kinds"),
                      F.get("drops", F.lit(0))["chance"].alias("drop_chance"), "palette_name", "palette_tint")


STAT = node("stat", {"name": "'Stat ' || n", "group": "lower(o_orderpriority)", "modifierKind": "CASE n % 4 WHEN 0 THEN 'damage' WHEN 1 THEN 'odd' WHEN 2 THEN 'primary' END",
                     "sourceKey": "CASE WHEN n % 4 < 2 OR n % 4 = 3 THEN cast(o_custkey AS string) ELSE ' ' END"})
query("N38_stats", f"""SELECT 'stat:stat ' || row_id AS id, word AS stat_group, CASE WHEN row_id % 4 = 0 THEN 'damage' END AS modifier_kind, CASE WHEN row_id % 4 = 0 THEN CAST(cust AS VARCHAR) END AS source_key,
  CASE row_id % 4 WHEN 1 THEN 'invalid_stat_modifier_kind' WHEN 2 THEN 'invalid_stat_modifier_source_key' WHEN 3 THEN 'incomplete_stat_modifier_selector' END AS code FROM {VIEW}""")(
    lambda spark, sf: crafts.parse_stats(rows(spark, sf, STAT)).select("id", "stat_group", "modifier_kind", "source_key", F.get("findings", F.lit(0))["code"].alias("code")))
query("N39_templates", f"SELECT 'template:grid ' || row_id AS id, row_id % 2 = 0 AS affects_player, '.#.,@@@' AS grid FROM {VIEW}")(
    lambda spark, sf: crafts.parse_templates(rows(spark, sf, node("template", {"name": "'Grid ' || n", "affectsPlayer": "cast(1 - n % 2 AS string)"}, node("row", {"text": "'.#.'"}), node("row", {}),
                                                                  node("row", {"text": "'@@@'"})))).select("id", "affects_player", F.array_join("rows", ",").alias("grid")))
query("N40_schema_drift", "SELECT event_id, 'Unsupported flags attribute k was preserved only as a diagnostic.' AS message FROM events WHERE props LIKE '%\"k\"%'")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", element("flags", {}).withField("attrs", F.from_json("props", "map<string,string>")).alias("record")).select(
        "event_id", F.explode(fields.drift(F.col("record"), "flags", {"known"}, set())).alias("f")).select("event_id", "f.message"))
query("S07_attribute_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", element("e", {}).withField("children", F.array(
        element("flags", {}, depth=RULE_LEVELS - 1).withField("attrs", F.from_json("props", "map<string,string>")))).alias("r")).select(
        "event_id", attribute(first_child(F.col("r"), "flags"), "k").alias("k"), attribute(first_child(F.col("r"), "other"), "k").alias("missing")))

ITEM = node("item", {"name": "CASE WHEN n % 9 <> 0 THEN 'Thing ' || n END", "iconFile": "'art\\\\x.png'", "alchemical": "'1'"}, node("price", {"amount": "CASE n % 3 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN '-4' END"}),
            node("stat", {"name": "'Zeal'", "amount": "'2'"}), node("stat", {"name": "'Aim'", "amount": "'q'"}), node("description", {"text": "lower(o_orderpriority)"}))


@query("N03_items", f"""SELECT 'item:thing ' || row_id AS id, word AS description, 'reagent' AS category, CASE row_id % 3 WHEN 0 THEN cust WHEN 1 THEN 0 END AS price, 'art/x.png' AS icon_path, 'aim' AS first_stat FROM {VIEW} WHERE row_id % 9 <> 0""")
def item_roots(spark, sf):
    got = items.parse_items(rows(spark, sf, ITEM))
    return got.select("id", "description", "category", "price", "icon_path", F.get("stats", F.lit(0))["stat_key"].alias("first_stat"))


query("N03_nameless_items", f"SELECT 'An <item> is missing its required name attribute.' AS message, count(*) AS n FROM {VIEW} WHERE row_id % 9 = 0")(
    lambda spark, sf: fields.nameless(rows(spark, sf, ITEM), "item").groupBy("message").agg(F.count(F.lit(1)).alias("n")))


@query("Q05_column_rules", f"""SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'skill level is a count' AS rule, 0 AS violations UNION ALL SELECT 'input amounts are positive', 0 UNION ALL SELECT 'output amounts are positive', count(*) FILTER (row_id % 4 = 0) FROM {VIEW}
  UNION ALL SELECT 'output skills are counts', 0)""")
def column_rules(spark, sf):
    """The recipe rules over normalised recipes, some of whose outputs are broken on purpose."""
    got = crafts.parse_recipes(rows(spark, sf, RECIPE)).withColumn("n", F.regexp_extract("id", "([0-9]+)", 1))
    broken = F.transform("outputs", lambda o: F.when(F.get("inputs", F.lit(0))["amount"] == 1, o.withField("amount", F.lit(0).cast("bigint"))).otherwise(o))
    return quality.rule_violations(got.withColumn("outputs", broken), quality.rules_for("recipe"))


# ---- historical readings -------------------------------------------------------------

OLD_SPELL = node(
    "spell", {"name": "'Old ' || n", "downtime": "CASE WHEN n % 2 = 0 THEN '5' END", "attack": "CASE n % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' END", "type": "CASE WHEN n % 5 = 0 THEN 'template' END"},
    node("effect", {"type": "'heal'", "amount": "cast(o_custkey AS string) || 'x'", "percentage": "CASE WHEN n % 2 = 0 THEN '100' ELSE '40' END"}),
    node("effect", {"type": "'paralyze'", "amount": "'3'", "turns": "'2'"}), node("buff", {"time": "'9'"}, node("effect", {"type": "'dot'", "amount": "'4'"}), node("mute", when="n % 7 = 0")),
    node("effect", {"type": "'unheard of'"}))
query("N42_historical_effects", f"""SELECT row_id, 'Heals' AS name, CAST(cust AS DOUBLE) AS amount, NULL AS duration, CASE WHEN row_id % 2 = 1 THEN '40' END AS chance FROM {VIEW}
UNION ALL SELECT row_id, 'Paralyzes', NULL, '2', '33' FROM {VIEW} UNION ALL SELECT row_id, 'Buff', NULL, '9', NULL FROM {VIEW} UNION ALL SELECT row_id, 'Repeated Trigger', NULL, '4', NULL FROM {VIEW}
UNION ALL SELECT row_id, 'Prevents Casting', NULL, NULL, NULL FROM {VIEW} WHERE row_id % 7 = 0 UNION ALL SELECT row_id, 'Cooldown', NULL, '5', NULL FROM {VIEW} WHERE row_id % 2 = 0
UNION ALL SELECT row_id, 'Performs Melee Attack', NULL, NULL, NULL FROM {VIEW} WHERE row_id % 3 = 1 UNION ALL SELECT row_id, 'Affects Area', NULL, NULL, NULL FROM {VIEW} WHERE row_id % 5 = 0""")(
    lambda spark, sf: rows(spark, sf, OLD_SPELL).select("row_id", F.explode(historical.spell_effects(F.col("record"))).alias("e")).select("row_id", "e.*"))
OLD_STATS = node(
    "item", {}, node("weapon", {"slashing": "cast(o_custkey AS string) || ' pts'", "crushingF": "'.5'", "primaryScale": "CASE WHEN n % 3 = 0 THEN '2' END", "secondaryScale": "CASE WHEN n % 2 = 0 THEN '7' ELSE '99' END"}),
    node("damagebuff", {"toxic": "'none'", "toxicF": "CASE WHEN n % 5 = 0 THEN '0' ELSE 'x' END"}), node("resistbuff", {"acidic": "CASE WHEN n % 4 = 0 THEN 'x' ELSE '3.5' END", "voltaic": "''"}),
    node("primarybuff", {"id": "cast(n % 8 AS string)", "amount": "'-2'"}), node("secondarybuff", {"id": "'20'", "amount": "'1e1x'"}), node("sightbuff", {"amount": "' 4'"}), node("DamageBuff", {"acidic": "'1'"}))
query("N43_historical_stats", f"""SELECT row_id, 'damage' AS kind, 'slashing' AS source_key, CAST(cust AS DOUBLE) AS amount, NULL AS factor_kind, NULL AS factor_key, CAST(NULL AS DOUBLE) AS factor FROM {VIEW}
UNION ALL SELECT row_id, 'damage', 'crushing', 0, CASE WHEN row_id % 3 = 0 THEN 'primary' ELSE 'secondary' END, CASE WHEN row_id % 3 = 0 THEN '2' WHEN row_id % 2 = 0 THEN '7' ELSE '3' END, 0.5 FROM {VIEW}
UNION ALL SELECT row_id, 'damage', 'toxic', 0, NULL, NULL, NULL FROM {VIEW} WHERE row_id % 5 = 0
UNION ALL SELECT row_id, 'resistance', 'acidic', CASE WHEN row_id % 4 <> 0 THEN 3.5 END, NULL, NULL, NULL FROM {VIEW}
UNION ALL SELECT row_id, 'primary', CAST(row_id % 8 AS VARCHAR), -2, NULL, NULL, NULL FROM {VIEW} WHERE row_id % 8 < 6
UNION ALL SELECT row_id, 'secondary', '20', 10, NULL, NULL, NULL FROM {VIEW} UNION ALL SELECT row_id, 'secondary', '18', 4, NULL, NULL, NULL FROM {VIEW}""")(
    lambda spark, sf: rows(spark, sf, OLD_STATS).select("row_id", F.explode(historical.stats(F.col("record"))).alias("s")).select("row_id", "s.*"))
OLD_TRIGGERS = node(
    "item", {}, node("effect", {"type": "CASE n % 3 WHEN 0 THEN 'trigger' WHEN 1 THEN 'dot' ELSE 'other' END", "spell": "'Wave'", "percentage": "'30'", "amount": "'4'", "resistable": "'0'"}),
    node("targetHitEffectBuff", {"name": "CASE WHEN n % 2 = 0 THEN 'Burn ' || o_custkey ELSE '' END", "spell": "'Spare'", "percent": "'101x'", "percentage": "'7'", "taxa": "'Animal'"}),
    node("triggeroncast", {}), node("targethiteffectbuff", {"name": "'no'"}))
query("N44_historical_triggers", f"""SELECT row_id, CAST(0 AS INT) AS place, 'melee-target' AS kind, CASE WHEN row_id % 2 = 0 THEN 'Burn ' || cust ELSE 'Spare' END AS spell, '101x' AS chance, '0' AS delay, '0' AS duration, FALSE AS unresistable, 'Animal' AS taxonomy FROM {VIEW}
UNION ALL SELECT row_id, 1, 'cast', NULL, NULL, '0', '0', FALSE, NULL FROM {VIEW}
UNION ALL SELECT row_id, 2, CASE row_id % 3 WHEN 0 THEN 'trigger-once' ELSE 'trigger-repeat' END, 'Wave', '30', CASE WHEN row_id % 3 = 0 THEN '4' ELSE '0' END, CASE WHEN row_id % 3 = 1 THEN '4' ELSE '0' END, TRUE, NULL FROM {VIEW} WHERE row_id % 3 <> 2""")(
    lambda spark, sf: rows(spark, sf, OLD_TRIGGERS).select("row_id", F.posexplode(historical.triggers(F.col("record"))).alias("place", "t")).select(
        "row_id", "place", "t.kind", "t.spell", "t.chance", "t.delay", "t.duration", "t.unresistable", "t.taxonomy"))
OLD_MONSTER = node("monster", {"name": "'M' || n", "level": "CASE n % 4 WHEN 0 THEN '-1' WHEN 1 THEN cast(n % 9 AS string) || ' or so' WHEN 2 THEN 'deep' END", "special": "CASE WHEN n % 2 = 0 THEN '1' ELSE '0' END"},
                   node("stats", {"numFig": "cast(o_custkey AS string) || '.9'", "numRog": "'x'"}))
query("N45_historical_monsters", f"""SELECT 'M' || row_id AS name, CASE WHEN row_id % 4 = 1 THEN row_id % 9 + 1 END AS depth, cust AS fighter, 0 AS rogue, row_id % 2 = 0 AS special FROM {VIEW}""", big="rogue")(
    lambda spark, sf: historical.parse_monsters(rows(spark, sf, OLD_MONSTER)).select("name", "depth", "fighter", "rogue", "special"))
OLD_CRAFT = node("craft", {"hidden": "CASE WHEN n % 3 = 0 THEN '1' END"}, node("tool", {"tag": "CASE n % 3 WHEN 0 THEN 'grinder' WHEN 1 THEN 'still' ELSE 'spoon' END"}),
                 node("output", {"name": "'Part ' || o_custkey", "amount": "CASE WHEN n % 2 = 0 THEN '4 units' ELSE '0' END", "skill": "cast(n % 6 AS string)"}))
query("N45_historical_crafts", f"""SELECT row_id, row_id % 3 = 0 AS hidden, CASE WHEN row_id % 2 = 0 THEN 4 ELSE 1 END AS amount, row_id % 6 AS skill, CASE WHEN row_id % 3 <> 2 THEN 'Alchemy' END AS stat FROM {VIEW}
UNION ALL SELECT row_id, TRUE, CASE WHEN row_id % 2 = 0 THEN 4 ELSE 1 END, row_id % 6, 'Tinkering' FROM {VIEW} WHERE row_id % 3 = 0""", big="amount")(
    lambda spark, sf: historical.parse_crafts(rows(spark, sf, OLD_CRAFT)).select("row_id", "hidden", "amount", "skill", "stat"))
OLD_ITEM = node(
    "item", {"name": "'I'", "type": "CASE WHEN n % 8 = 0 THEN cast(o_custkey % 12 AS string) END", "overrideClassName": "CASE WHEN n % 8 = 1 THEN 'Orb' END", "alchemical": "CASE WHEN n % 8 IN (4, 5) THEN '1' END"},
    node("weapon", when="n % 8 = 0"), node("armour", {"type": "CASE n % 8 WHEN 1 THEN 'shield' WHEN 2 THEN 'sleeve' ELSE 'odd' END"}, when="n % 8 IN (1, 2, 7)"), node("food", {"mp": "'3'"}, when="n % 8 = 3"),
    node("toolkit", when="n % 8 = 4"))
query("N46_historical_classes", f"""SELECT row_id, CASE row_id % 8 WHEN 0 THEN coalesce(['Sword Class Weapon', 'Axe Class Weapon', 'Mace Class Weapon', 'Staff Class Weapon', 'Crossbow Class Weapon', 'Throwing Class Weapon', 'Ammunition', 'Dagger Class Weapon', 'Polearm Class Weapon'][cust % 12 + 1], 'Weapon')
  WHEN 1 THEN 'Orb' WHEN 2 THEN 'Armor (Sleeve)' WHEN 3 THEN 'Booze' WHEN 4 THEN 'Toolkit' WHEN 5 THEN 'Reagent' WHEN 6 THEN 'Item' ELSE 'Armour' END AS class FROM {VIEW}""")(
    lambda spark, sf: rows(spark, sf, OLD_ITEM).select("row_id", historical.item_class(F.col("record")).alias("class")))
# Stats of a buff are also read from the effects directly inside it.
OLD_EFFECTS = node(
    "spell", {"downtime": "CASE WHEN n % 2 = 0 THEN '' END", "attack": "CASE n % 3 WHEN 0 THEN '0' WHEN 1 THEN '2 x' END", "type": "CASE WHEN n % 5 = 0 THEN 'template' END", "templateID": "'T' || n % 9",
              "anchored": "CASE WHEN n % 4 = 0 THEN '1' END", "mine": "'1'", "mineradius": "CASE n % 3 WHEN 0 THEN '1' WHEN 1 THEN '2.5' ELSE '3x' END", "minePermanent": "CASE n % 2 WHEN 0 THEN '' ELSE '0' END"},
    node("requirements", {"mp": "cast(o_custkey AS string) || 'mp'", "savvyBonus": "CASE WHEN n % 2 = 0 THEN '.25' END", "mincost": "'3'"}),
    node("buff", {"time": "'9'", "icon": "'b'", "stacksize": "cast(n % 3 AS string)", "allowstacking": "CASE WHEN n % 4 = 0 THEN '0' END", "removable": "'1'", "percentage": "'100'"},
         node("primarybuff", {"id": "'1'", "amount": "'2'"}),
         node("effect", {"type": "'damage'", "slashing": "'4'", "bleed": "CASE WHEN n % 7 = 0 THEN '1' END", "resistable": "'0'"}, node("option", {"name": "'no'"}))),
    node("effect", {"type": "'spawnitemfromlist'", "percent": "''", "percentage": "'40'"}, node("option", {"name": "'Part ' || o_custkey"}), node("option", {"name": "'Spoon'"})),
    node("effect", {"type": "CASE n % 2 WHEN 0 THEN 'summon' ELSE 'paralyze' END", "amount": "CASE n % 4 WHEN 0 THEN '' ELSE cast(n % 4 AS string) END", "monsterType": "'Diggle'", "turns": "'2'", "self": "'1'"}),
    node("effect", {"type": "'trigger'", "spell": "''", "name": "'Wave'", "amount": "CASE n % 2 WHEN 0 THEN '0' ELSE '4' END", "taxa": "'Animal'"}))
SQL_EFFECT = "SELECT row_id, {} FROM " + VIEW + " WHERE {}"
EFFECT_COLUMNS = ("rank", "name", "duration", "chance", "spell", "trigger", "items", "quantity", "monster", "minimum", "template", "radius", "brittle", "stack_size", "unresistable", "stats")


def old_effect(when="TRUE", **given):
    none = {"rank": "NULL", "unresistable": "FALSE", "stats": "''", "items": "''"}
    shown = ", ".join(f"{given.get(c, none.get(c, 'CAST(NULL AS VARCHAR)'))} AS {c}" for c in EFFECT_COLUMNS)
    return SQL_EFFECT.format(shown, when)


query("N42_historical_effect_fields", " UNION ALL ".join([
    old_effect("row_id % 2 = 0", rank="1", name="'Cooldown'", duration="''", unresistable="NULL"),
    old_effect(rank="2", name="'Mana Cost'", minimum="'3'", unresistable="NULL", stats="'secondary 1 ' || cust || CASE WHEN row_id % 2 = 0 THEN ' primary 5 -25' ELSE '' END"),
    old_effect("row_id % 3 = 1", rank="3", name="'Performs Melee Attack'", unresistable="NULL"),
    old_effect("row_id % 5 = 0", rank="4", name="'Affects Area'", template="'T' || row_id % 9"),
    old_effect(rank="5", name="'Buff'", duration="'9'", stack_size="CASE WHEN row_id % 4 <> 0 AND row_id % 3 <> 1 THEN CAST(row_id % 3 AS VARCHAR) END", stats="'damage slashing 4; primary 1 2'"),
    old_effect(rank="6", name="'Mine'", radius="CASE WHEN row_id % 3 = 1 THEN '2.5' END", brittle="CASE WHEN row_id % 2 = 0 THEN '1' END"),
    old_effect(rank="7", name="'Trigger'", spell="'Wave'", trigger="'trigger-once'"),
    old_effect(rank="18", name="'Damages'", unresistable="TRUE", stats="'damage slashing 4' || CASE WHEN row_id % 3 = 1 THEN '; damage crushing 0 secondary 2 200' ELSE '' END"),
    old_effect("row_id % 7 = 0", rank="19", name="'Starts Bleeding'", unresistable="TRUE"),
    old_effect("row_id % 2 = 1", rank="23", name="'Paralyzes'", duration="'2'", chance="CASE row_id % 4 WHEN 1 THEN '100' ELSE '33' END"),
    old_effect(rank="39", name="'Spawns an Item'", chance="'40'", items="'Part ' || cust || ', Spoon'"),
    old_effect("row_id % 2 = 0", rank="41", name="'Summons'", quantity="CASE row_id % 4 WHEN 0 THEN '1' ELSE '2' END", monster="'Diggle'")]))(
    lambda spark, sf: historical_records.effect_rows(rows(spark, sf, OLD_EFFECTS)).select(
        "row_id", *[F.coalesce(F.array_join("items", ", "), F.lit("")).alias(c) if c == "items" else F.array_join(F.transform("stats", lambda s: F.concat_ws(
            " ", s["kind"], s["source_key"], s["amount"].cast("bigint"), s["factor_kind"], s["factor_key"], (s["factor"] * 100).cast("bigint"))), "; ").alias(c) if c == "stats" else c
            for c in EFFECT_COLUMNS]))
query("N45_historical_spells", f"""SELECT row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE upper(word[1]) END AS category, CASE WHEN row_id % 2 = 0 THEN 'src' || row_id % 3 || '/b.png' END AS icon,
  CASE WHEN row_id % 4 = 0 THEN 'missile' ELSE 'unknown' END AS type, 'Said' AS description FROM {{0}}""".replace("{0}", VIEW.replace("lower(o_orderpriority)", "lower(substr(o_orderpriority, 3))")))(
    lambda spark, sf: historical_records.parse_spells(rows(spark, sf, node(
        "spell", {"name": "CASE WHEN n % 3 = 0 THEN '(' ELSE '' END || lower(substr(o_orderpriority, 3))", "icon": "'own.png'", "type": "CASE n % 4 WHEN 0 THEN 'missile' WHEN 1 THEN 'Missile' END"},
        node("description", {"text": "'Said'"}), node("buff", {"icon": "'a.png'"}), node("buff", {"icon": "CASE WHEN n % 2 = 0 THEN 'b.png' END"}))), F.col("source_id")).select("row_id", "category", "icon", "type", "description"))
OLD_WARES = node(
    "item", {"name": "'I' || n", "level": "'5'", "iconFile": "CASE WHEN n % 3 = 0 THEN 'i.png' WHEN n % 3 = 1 THEN '' END", "type": "CASE WHEN n % 6 = 0 THEN '4' END"}, node("price", {"amount": "cast(o_custkey AS string)"}),
    node("artifact", {"quality": "'7'"}, when="n % 5 = 0"), node("weapon", {"hit": "'Zap'", "canTargetFloor": "CASE WHEN n % 4 = 0 THEN '1' END", "slashing": "'3'"}, when="n % 6 = 0"),
    node("armour", {"type": "'ring'", "level": "'8'", "randoms": "CASE WHEN n % 4 = 1 THEN '0.0' END"}, when="n % 6 = 1"), node("food", {"hp": "'6'", "effect": "CASE WHEN n % 4 = 2 THEN 'Full' END"}, when="n % 6 = 2"),
    node("trap", {"level": "'1'", "casts": "'Snap'"}, when="n % 6 = 3"), node("trap", {"level": "'2'", "casts": "'Crack'"}, when="n % 6 = 3"), node("wand", {"mincharge": "'2'", "spell": "'Glow'"}, when="n % 6 = 4"),
    node("potion", {"spell": "'Gulp'"}, when="n % 6 = 5"))
query("N45_historical_items", f"""SELECT row_id, ['Crossbow Class Weapon', 'Armor (Ring)', 'Food', 'Trap', 'Wand', 'Potion'][row_id % 6 + 1] AS class, CAST(cust AS VARCHAR) AS price, ['5', '8', '0', '2', '0', '0'][row_id % 6 + 1] AS quality,
  CASE row_id % 3 WHEN 0 THEN 'src0/i.png' WHEN 1 THEN '' END AS icon, CAST(row_id % 6 = 0 AS INT) AS n_stats,
  CASE WHEN row_id % 5 = 0 THEN 'Artifact Quality 7; ' ELSE '' END || CASE row_id % 6 WHEN 0 THEN CASE WHEN row_id % 4 = 0 THEN 'Can target the floor; Cannot be recovered; ' ELSE '' END || 'Zap item-hit; '
    WHEN 1 THEN CASE WHEN row_id % 4 = 1 THEN '' ELSE 'Random Stats; ' END WHEN 2 THEN 'Food secondary 0 6; ' || CASE WHEN row_id % 4 = 2 THEN 'Full eaten; ' ELSE '' END WHEN 3 THEN 'Snap stepped-on; Crack stepped-on; '
    WHEN 4 THEN 'Wand 2 - undefined charges; Glow zapped; ' ELSE 'Gulp quaffed; ' END AS effects FROM {VIEW}""")(
    lambda spark, sf: historical_records.parse_items(rows(spark, sf, OLD_WARES), F.col("source_id")).select(
        "row_id", "class", "price", "quality", "icon", F.size("stats").alias("n_stats"),
        F.array_join(F.transform("effects", lambda e: F.concat(F.concat_ws(" ", *[e[c] for c in ("name", "description", "kind", "source_key", "amount", "spell", "trigger")]), F.lit("; "))), "").alias("effects")))
OLD_ENCRUST = node("encrust", {"name": "'E' || n", "hidden": "CASE WHEN n % 3 = 0 THEN '1' END"}, node("description", {"text": "'Said'"}), node("tool", {"tag": "CASE n % 3 WHEN 0 THEN 'grinder' WHEN 1 THEN 'still' ELSE 'spoon' END"}),
                   node("input", {"name": "'Part ' || o_custkey"}), node("input", {"name": "'Spoon'"}, when="n % 2 = 0"), node("skill", {"level": "cast(n % 6 AS string) || '.5'"}), node("skill", {"level": "'x'"}, when="n % 5 = 0"))
query("N45_historical_encrusts", f"""SELECT row_id, 'Said' AS description, row_id % 3 = 0 AS hidden, 'Part ' || cust || CASE WHEN row_id % 2 = 0 THEN ', Spoon' ELSE '' END AS inputs,
  CASE row_id % 3 WHEN 0 THEN 'Alchemy ' || row_id % 6 || ', Tinkering ' || row_id % 6 WHEN 1 THEN 'Alchemy ' || row_id % 6 ELSE '' END
  || CASE WHEN row_id % 5 = 0 THEN CASE row_id % 3 WHEN 0 THEN ', Alchemy ?, Tinkering ?' WHEN 1 THEN ', Alchemy ?' ELSE '' END ELSE '' END AS outputs FROM {VIEW}""")(
    lambda spark, sf: historical_records.parse_encrusts(rows(spark, sf, OLD_ENCRUST)).select(
        "row_id", "description", "hidden", F.array_join("inputs", ", ").alias("inputs"),
        F.array_join(F.transform(F.flatten("outputs"), lambda o: F.concat_ws(" ", o["stat"], F.coalesce(o["amount"].cast("string"), F.lit("?")))), ", ").alias("outputs")))
OLD_SKILL = node("skill", {"id": "CASE WHEN n % 9 <> 0 THEN 's' || n END", "name": "'S' || o_custkey", "type": "CASE n % 3 WHEN 0 THEN 'rogue' ELSE 'Rogue' END"}, node("art", {"icon": "'s.png'"}),
                 node("loadout", {"subtype": "'Part ' || o_custkey", "type": "'weapon'", "always": "CASE n % 2 WHEN 0 THEN '0' ELSE '' END"}), node("loadout", {"subtype": "''", "type": "'armour'", "amount": "'3'"}))
query("N45_historical_skills", f"""SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'Rogue' END AS archetype, 'src' || row_id % 3 || '/s.png' AS icon,
  'Part ' || cust || ' x 1' || CASE WHEN row_id % 2 = 0 THEN ' always' ELSE '' END || ', any armour x 3' AS loadouts FROM {VIEW}""")(
    lambda spark, sf: historical_records.parse_skills(rows(spark, sf, OLD_SKILL), F.col("source_id")).select("row_id", "archetype", "icon", F.array_join(F.transform("loadouts", lambda x: F.concat_ws(
        " ", x["item"], F.concat(F.lit("any "), x["item_type"]), F.lit("x"), x["amount"], F.when(x["always"], "always"))), ", ").alias("loadouts")))
query("N45_historical_abilities", f"""SELECT row_id AS skill_row, row_id, 'A' || cust AS name, 'src' || row_id % 3 || '/a.png' AS icon, 'secondary 3 ' || row_id % 6 AS stats, 'Spark' AS spell FROM {VIEW} WHERE row_id % 9 <> 0 AND row_id % 4 <> 0""")(
    lambda spark, sf: historical_records.skill_abilities(rows(spark, sf, OLD_SKILL).filter("record.attrs['id'] IS NOT NULL"), rows(spark, sf, node(
        "ability", {"skill": "CASE WHEN n % 4 <> 0 THEN 's' || n END", "name": "'A' || o_custkey", "icon": "'a.png'"}, node("secondarybuff", {"id": "'3'", "amount": "cast(n % 6 AS string)"}),
        node("targetHitEffectBuff", {"name": "'Spark'"}))), F.col("source_id")).select("skill_row", "row_id", "name", "icon", F.array_join(F.transform(
            "stats", lambda s: F.concat_ws(" ", s["kind"], s["source_key"], s["amount"].cast("bigint"))), ", ").alias("stats"), F.get("triggers", F.lit(0))["spell"].alias("spell")))
query("N45_historical_templates", f"""SELECT 'T' || row_id AS name, '@#' || repeat('#', CAST(cust % 5 AS INT)) || '|' || CASE WHEN row_id % 2 = 0 THEN '.#|' ELSE '' END AS cells, row_id % 3 = 0 AS affects_anchor FROM {VIEW}""")(
    lambda spark, sf: historical_records.parse_templates(rows(spark, sf, node(
        "template", {"name": "'T' || n", "affectsPlayer": "CASE n % 3 WHEN 0 THEN '1' WHEN 1 THEN 'true' END"}, node("row", {"text": "'@#' || repeat('#', cast(o_custkey % 5 AS int))"}),
        node("row", {"text": "'.#'"}, when="n % 2 = 0")))).select("name", F.array_join(F.transform("cells", lambda c: F.concat(c, F.lit("|"))), "").alias("cells"), "affects_anchor"))
