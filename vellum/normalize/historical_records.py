"""Historical readings of whole records: items, encrustments, skills with abilities, templates, spells, and every effect of a spell.

Texts are kept as they are unless a rule compares numbers. An empty attribute counts
as missing where the reading falls back to something else. Elements are looked for
among those directly inside a record; effects of spells on all levels that a record
column holds. Effects are rows, so that their many fields are plain columns instead of
expressions inside of lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import lookup
from ..functions.records import RULE_LEVELS, attribute, child_attribute, children, first_child, named
from ..operators.backlinks import tool_stats
from .historical import (
    ARMOUR_NAMES, EFFECT_NAMES, ELEMENT_NAMES, TRIGGERS, WEAPON_NAMES, _STAT, _stat, chance, item_class, loose_integer, loose_number, stats, triggers)

# ---- Fixed values: historical texts, and the shapes of effects in reading order ----
ARCHETYPES = {"warrior": "Warrior", "rogue": "Rogue", "wizard": "Wizard"}
SPELL_TYPES = ["self", "missile", "template", "adjacent", "target", "targetfloor", "targetcorpse", "targetadjacentcorpse", "item", "fireball", "knightlyleap"]
SHAPES = [
    "spell:downtime", "requirements", "spell:attack", "spell:template", "buff", "spell:mine", "effect:trigger", "effect:dot", "targetHitEffectBuff",
    "crossbowShotBuff", "thrownBuff", "targetKillBuff", "playerHitEffectBuff", "effect:heal", "effect:spellpoints", "effect:drain", "effect:drainMana",
    "effect:damage", "effect:bleed", "effect:knock", "effect:shout", "effect:uncurse", "effect:paralyze", "effect:sleep", "effect:confuse",
    "effect:charm", "effect:fear", "effect:pacify", "effect:lockdown", "invisible", "effect:removeinvisibility", "mute", "polymorph",
    "effect:teleport", "effect:blink", "effect:targetblink", "effect:displace", "effect:spawn", "effect:spawnitemfromlist",
    "effect:spawnitematlocation", "effect:summon", "effect:resurrection", "effect:corrupt", "effect:sacrificeartifact", "effect:randomizeartifact",
    "effect:cleanseartifact", "effect:vendingmachinesteal", "effect:stealitem", "effect:dig", "effect:create", "effect:rechargeanvil", "effect:grantxp",
]
SPELL_NAMES = {"spell:downtime": "Cooldown", "spell:attack": "Performs Melee Attack", "spell:template": "Affects Area", "spell:mine": "Mine"}
LIFE, MANA, MELEE_POWER, MAGIC_POWER, SAVVY, EXPERIENCE = (
    ("secondary", "0"), ("secondary", "1"), ("secondary", "2"), ("secondary", "3"), ("primary", "5"), ("secondary", "99"))
# ---- end of fixed values ----

EFFECT_LABELS = {**{f"effect:{k}": v for k, v in EFFECT_NAMES.items()}, **ELEMENT_NAMES, **SPELL_NAMES}
BUFF_TRIGGERS = [s for s in SHAPES if s.endswith("Buff")]


def path_in(folder: Column, path: Column) -> Column:
    """A path below the folder of its source; a missing one stays as it is."""
    return F.when(path != "", F.concat(folder, F.lit("/"), path)).otherwise(path)


def common(record: Column) -> list[Column]:
    return [attribute(record, "name").alias("name"), child_attribute(record, "description", "text").alias("description")]


# ---- effects of spells ---------------------------------------------------------------


def elements(record: Column) -> Column:
    """The record and what is inside it, level by level, each with the tags and attributes directly inside."""
    def part(c: Column, kids: Column) -> Column:
        inside = F.transform(kids, lambda k: F.struct(k["tag"].alias("tag"), k["attrs"].alias("attrs")))
        return F.struct(c["tag"].alias("tag"), c["attrs"].alias("attrs"), inside.alias("children"))

    level, parts = F.array(record), []
    for _ in range(RULE_LEVELS):
        parts.append(F.transform(level, lambda c: part(c, c["children"])))
        level = F.flatten(F.transform(F.filter(level, lambda c: c["children"].isNotNull()), lambda c: c["children"]))
    nothing = F.array().cast("array<struct<tag:string,attrs:map<string,string>>>")
    return F.concat(*parts, F.transform(level, lambda c: part(c, nothing)))


def shapes(e: Column) -> Column:
    """The shapes of SHAPES that an element has; a spell may have several, a bleeding effect has two."""
    kind, spell = attribute(e, "type"), e["tag"] == "spell"
    plain = F.when(e["tag"] == "effect", F.concat(F.lit("effect:"), kind)).otherwise(e["tag"])
    found = F.array(
        F.when(spell & attribute(e, "downtime").isNotNull(), "spell:downtime"), F.when(spell & (attribute(e, "attack") != "0"), "spell:attack"),
        F.when(spell & (kind == "template"), "spell:template"), F.when(spell & (attribute(e, "mine") == "1"), "spell:mine"),
        F.when(plain.isin(*SHAPES), plain),
        F.when((e["tag"] == "effect") & (attribute(e, "bleed") == "1") & ~kind.eqNullSafe("bleed"), "effect:bleed"))
    return F.filter(found, lambda s: s.isNotNull())


def effect_stats(shape: Column, e: Column, attack: Column) -> Column:
    """Stats that an effect changes: its own, those of its shape, and melee power for the damage of an attack spell."""
    def one(condition: Column, stat: tuple, amount: Column, factor: Column | None = None, scale: tuple | None = None) -> Column:
        made = _stat(stat[0], F.lit(stat[1]), amount, factor, scale and tuple(F.lit(x) for x in scale))
        return F.when(condition, F.array(made).cast(_STAT))

    amount, factor, zero = loose_number(attribute(e, "amount")), loose_number(attribute(e, "amountF")), F.lit(0.0)
    crushing, share = ("damage", "crushing"), loose_integer(attribute(e, "amount")) / 100
    parts = [
        one(shape == "requirements", MANA, loose_number(attribute(e, "mp")), -loose_number(attribute(e, "savvyBonus")), SAVVY),
        one(shape == "effect:heal", LIFE, amount, factor, MAGIC_POWER), one(shape == "effect:spellpoints", MANA, amount, factor, MAGIC_POWER),
        F.when(shape.isin("buff", "effect:drain", "effect:drainMana", "effect:damage"), stats(e).cast(_STAT)),
        one(shape == "effect:drainMana", MANA, zero, share, MANA),
        one((shape == "effect:damage") & (attack != 0), crushing, zero, attack.cast("double"), MELEE_POWER),
        one(shape == "effect:grantxp", EXPERIENCE, amount)]
    nothing = F.array().cast(_STAT)
    return F.concat(*[F.coalesce(p, nothing) for p in parts])


def effect_rows(records: DataFrame) -> DataFrame:
    """One row per effect of a spell (``row_id``); ``rank`` is the place of its shape in SHAPES, ``at`` that of its element.

    A factor that lowers a cost is negative. The chance of paralysis is one in
    ``amount``. A missing quantity is one. Cooldown, cost and melee attack have
    none of the fields that other effects share.
    """
    record = F.col("record")
    flat = records.select("row_id", loose_integer(attribute(record, "attack")).alias("attack"), F.posexplode(elements(record)).alias("at", "e"))
    rows = flat.select("row_id", "attack", "at", "e", F.explode(shapes(F.col("e"))).alias("shape"))
    e, shape = F.col("e"), F.col("shape")
    a = lambda name: attribute(e, name)
    text = lambda name: named(e, name)
    shared = ~shape.isin("spell:downtime", "requirements", "spell:attack")
    flag = lambda name, value="1": F.when(shared, F.coalesce(a(name) == value, F.lit(False)))
    buff, mine, start = shape == "buff", shape == "spell:mine", shape.isin("effect:trigger", "effect:dot")
    one_in = F.coalesce(F.nullif(loose_integer(a("amount")), F.lit(0)), F.lit(1))
    stacks = ~(a("stackable").eqNullSafe("0") | a("allowstacking").eqNullSafe("0") | a("stacksize").eqNullSafe("1"))
    listed = F.transform(children(e, "option"), lambda o: attribute(o, "name"))
    fields = {
        "duration": F.when(shape == "spell:downtime", a("downtime")).when(buff, a("time")).when(mine, a("mineTimer"))
        .when(shape == "effect:dot", a("amount")).when(shape.isin("effect:paralyze", "effect:create"), a("turns")),
        "chance": F.when(shape == "effect:paralyze", F.round(F.lit(100.0) / one_in).cast("bigint").cast("string")).when(shared, chance(e)),
        "delay": F.when((shape == "effect:trigger") & (a("amount") != "0"), text("amount")),
        "spell": F.when(start, F.coalesce(text("spell"), a("name"))).when(shape.isin(*BUFF_TRIGGERS), a("name")),
        "trigger": F.when(start | shape.isin(*BUFF_TRIGGERS), lookup(TRIGGERS, shape)),
        "items": F.when(shape.isin("effect:spawn", "effect:spawnitematlocation"), F.array(a("itemname"))).when(shape == "effect:spawnitemfromlist", listed),
        "quantity": F.when(shape == "effect:summon", F.coalesce(text("amount"), F.lit("1"))),
        "monster": F.when(shape == "effect:summon", a("monsterType")).when(shape == "polymorph", a("name")),
        "minimum": F.when(shape == "requirements", a("mincost")),
        "template": F.when(shape == "spell:template", a("templateID")),
        "anchored": F.when(shape == "spell:template", F.coalesce(a("anchored") == "1", F.lit(False))),
        "radius": F.when(mine & (F.trim(a("mineradius")).try_cast("double") > 1), a("mineradius")),
        "upkeep": F.when(buff, a("manaUpkeep")), "attacks": F.when(buff, a("attacks")),
        "brittle": F.when(buff, a("brittle")).when(mine & text("minePermanent").isNull(), "1"),
        "removable": F.when(buff, F.coalesce(a("removable") == "1", F.lit(False))), "stack_size": F.when(buff & stacks, a("stacksize")),
        "affects_caster": F.when(shared, F.coalesce((a("affectscaster") == "1"), F.lit(False)) | F.coalesce(a("affectsCaster") == "1", F.lit(False))),
        "self": flag("self"), "burn": flag("burn"), "unresistable": flag("resistable", "0"), "taxonomy": F.when(shared, a("taxa")),
        "stats": effect_stats(shape, e, F.col("attack")),
    }
    order = F.array(*[F.lit(s) for s in SHAPES])
    return rows.select("row_id", F.array_position(order, shape).cast("int").alias("rank"), "at", "shape", lookup(EFFECT_LABELS, shape).alias("name"),
                       *[value.alias(column) for column, value in fields.items()])


def parse_spells(records: DataFrame, folder: Column) -> DataFrame:
    """Spells with category and type; the icon of the last buff replaces that of the spell, even by none."""
    record = F.col("record")
    first = F.upper(F.substring(attribute(record, "name"), 1, 1))
    buffs = children(record, "buff")
    icon = F.when(F.size(buffs) > 0, attribute(F.try_element_at(buffs, F.lit(-1)), "icon")).otherwise(attribute(record, "icon"))
    return records.select(
        "row_id", *common(record), F.when(first.rlike("^[0-9A-Z]$"), first).alias("category"), path_in(folder, icon).alias("icon"),
        F.when(attribute(record, "type").isin(*SPELL_TYPES), attribute(record, "type")).otherwise("unknown").alias("type"))


# ---- other kinds ---------------------------------------------------------------------


def item_effects(record: Column, kind: Column) -> Column:
    """Effects that come from the class of an item: what is eaten, drunk, charged, hit or stepped on."""
    none = F.lit(None).cast("string")

    def made(name=None, description=none, stat=(None, None), amount=none, spell=none, trigger=None) -> Column:
        return F.struct(
            F.lit(name).cast("string").alias("name"), description.alias("description"), F.lit(stat[0]).cast("string").alias("kind"),
            F.lit(stat[1]).cast("string").alias("source_key"), amount.alias("amount"), spell.alias("spell"), F.lit(trigger).cast("string").alias("trigger"))

    def each(tag: str, *read) -> Column:
        found = F.transform(children(record, tag), lambda c: F.filter(F.array(*[r(c) for r in read]), lambda x: x.isNotNull()))
        return F.flatten(found)

    def shown(c: Column, name: str) -> Column:
        return F.coalesce(attribute(c, name), F.lit("undefined"))

    def meal(tag: str, stat: tuple, source: str, trigger: str) -> Column:
        return each("food", lambda c: made(tag, stat=stat, amount=attribute(c, source)),
                    lambda c: F.when(attribute(c, "effect") != "", made(spell=attribute(c, "effect"), trigger=trigger)))

    hits = lambda c: attribute(c, "hit") != ""
    floor = lambda c: hits(c) & (attribute(c, "canTargetFloor") != "")
    randoms = child_attribute(record, "armour", "randoms")
    fixed = F.coalesce((F.trim(randoms) == "") | (F.trim(randoms).try_cast("double") == 0), F.lit(False))
    weapons = [*WEAPON_NAMES.values(), "Weapon"]
    by_class = (
        F.when(kind.isin(ARMOUR_NAMES["ring"], ARMOUR_NAMES["neck"]) & ~fixed, F.array(made("Random Stats")))
        .when(kind == "Food", meal("Food", LIFE, "hp", "eaten")).when(kind == "Booze", meal("Booze", MANA, "mp", "drunk"))
        .when(kind == "Trap", each("trap", lambda c: made(spell=attribute(c, "casts"), trigger="stepped-on")))
        .when(kind == "Wand", each(
            "wand", lambda c: made("Wand", F.concat(shown(c, "mincharge"), F.lit(" - "), shown(c, "maxcharge"), F.lit(" charges"))),
            lambda c: made(spell=attribute(c, "spell"), trigger="zapped")))
        .when(kind == "Potion", F.array(made(spell=child_attribute(record, "potion", "spell"), trigger="quaffed")))
        .when(kind == "Mushroom", F.array(made(spell=child_attribute(record, "casts", "spell"), trigger="munched")))
        .when(kind.isin(*weapons), each(
            "weapon", lambda c: F.when(floor(c), made("Can target the floor")), lambda c: F.when(floor(c), made("Cannot be recovered")),
            lambda c: F.when(hits(c), made(spell=attribute(c, "hit"), trigger="item-hit")))))
    artifacts = each("artifact", lambda c: made("Artifact", F.concat(F.lit("Quality "), shown(c, "quality"))))
    return F.concat(artifacts, F.coalesce(by_class, F.filter(F.array(made()), lambda x: F.lit(False))))


def parse_items(records: DataFrame, folder: Column) -> DataFrame:
    """Items with class, price, quality (of the weapon's item, the armour or the last trap; else 0), stats, effects and triggers."""
    record = F.col("record")
    kind = F.col("class")
    armours = [*ARMOUR_NAMES.values(), "Armor (Sleeve)", "Armour", "Orb", "Tome"]
    quality = (
        F.when(kind.isin(*WEAPON_NAMES.values(), "Weapon"), attribute(record, "level")).when(kind.isin(*armours), child_attribute(record, "armour", "level"))
        .when(kind == "Trap", attribute(F.try_element_at(children(record, "trap"), F.lit(-1)), "level")).otherwise("0"))
    return records.withColumn("class", item_class(record)).select(
        "row_id", *common(record), "class", child_attribute(record, "price", "amount").alias("price"), quality.alias("quality"),
        path_in(folder, attribute(record, "iconFile")).alias("icon"), stats(record).alias("stats"), item_effects(record, kind).alias("effects"),
        triggers(record).alias("triggers"))


def parse_encrusts(records: DataFrame) -> DataFrame:
    """Encrustments with the names they take, and per skill declaration the stats that the tool trains at its level."""
    record = F.col("record")
    tool = child_attribute(record, "tool", "tag")
    trained = F.coalesce(tool_stats(tool), F.array().cast("array<string>"))
    outputs = F.transform(children(record, "skill"), lambda c: F.transform(
        trained, lambda s: F.struct(s.alias("stat"), loose_integer(attribute(c, "level")).alias("amount"))))
    return records.select(
        "row_id", *common(record), tool.alias("tool"), F.coalesce(attribute(record, "hidden") == "1", F.lit(False)).alias("hidden"),
        F.transform(children(record, "input"), lambda c: attribute(c, "name")).alias("inputs"), outputs.alias("outputs"))


def parse_skills(records: DataFrame, folder: Column) -> DataFrame:
    """Skills with archetype and loadouts; a loadout names an item or else a type of items."""
    record = F.col("record")
    loadouts = F.transform(children(record, "loadout"), lambda c: F.struct(
        F.coalesce(attribute(c, "always") != "", F.lit(False)).alias("always"), F.coalesce(named(c, "amount"), F.lit("1")).alias("amount"),
        named(c, "subtype").alias("item"), F.when(named(c, "subtype").isNull(), attribute(c, "type")).alias("item_type")))
    return records.select(
        "row_id", attribute(record, "id").alias("skill_id"), attribute(record, "name").alias("name"), attribute(record, "description").alias("description"),
        path_in(folder, attribute(first_child(record, "art"), "icon")).alias("icon"), lookup(ARCHETYPES, attribute(record, "type")).alias("archetype"),
        loadouts.alias("loadouts"))


def skill_abilities(skills: DataFrame, abilities: DataFrame, folder: Column) -> DataFrame:
    """Abilities of each skill of the same file, one row each, with stats and triggers; those without a skill go to skills without an id."""
    record = F.col("record")
    owned = skills.select("source_id", "file", F.col("row_id").alias("skill_row"), attribute(record, "id").alias("skill_id"))
    read = abilities.select(
        F.col("source_id").alias("a_source"), F.col("file").alias("a_file"), attribute(record, "skill").alias("of_skill"), "row_id", *common(record),
        path_in(folder, attribute(record, "icon")).alias("icon"), stats(record).alias("stats"), triggers(record).alias("triggers"))
    same = (F.col("source_id") == F.col("a_source")) & (F.col("file") == F.col("a_file")) & F.col("skill_id").eqNullSafe(F.col("of_skill"))
    return owned.join(read, same).drop("source_id", "file", "a_source", "a_file", "of_skill")


def parse_templates(records: DataFrame) -> DataFrame:
    """Templates as the texts of their rows."""
    record = F.col("record")
    return records.select(
        "row_id", attribute(record, "name").alias("name"), F.transform(children(record, "row"), lambda c: attribute(c, "text")).alias("cells"),
        F.coalesce(attribute(record, "affectsPlayer") == "1", F.lit(False)).alias("affects_anchor"))
