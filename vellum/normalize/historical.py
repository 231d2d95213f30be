"""The historical reading of the same records: looser numbers, its own item classes and effect names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import lookup
from ..functions.records import attribute, child_attribute, children, has_child
from ..operators.backlinks import tool_stats
from ..operators.quality import DAMAGE_KEYS
from ..sources.inputs import PRIMARY_STATS, SECONDARY_STATS

# ---- Fixed values: historical texts ----
WEAPON_NAMES = {
    "0": "Sword Class Weapon", "1": "Axe Class Weapon", "2": "Mace Class Weapon", "3": "Staff Class Weapon", "4": "Crossbow Class Weapon",
    "5": "Throwing Class Weapon", "6": "Ammunition", "7": "Dagger Class Weapon", "8": "Polearm Class Weapon",
}
ARMOUR_NAMES = {
    "head": "Armor (Head)", "chest": "Armor (Torso)", "legs": "Armor (Pants)", "hands": "Armor (Gloves)", "feet": "Armor (Shoes)",
    "waist": "Armor (Belt)", "shield": "Armor (Shield)", "ring": "Armor (Ring)", "neck": "Armor (Amulet)",
}
EFFECT_NAMES = {
    "trigger": "Trigger", "dot": "Repeated Trigger", "heal": "Heals", "spellpoints": "Recovers", "drain": "Drains Life", "drainMana": "Drains Mana",
    "damage": "Damages", "bleed": "Starts Bleeding", "knock": "Knocks back", "shout": "Aggravates", "uncurse": "Removes Curses",
    "paralyze": "Paralyzes", "sleep": "Puts to Sleep", "confuse": "Confuses", "charm": "Charms", "fear": "Scares Away", "pacify": "Pacifies",
    "lockdown": "Prevents movement", "removeinvisibility": "Removes Invisibility", "teleport": "Teleports", "blink": "Randomly Teleports",
    "targetblink": "Randomly Teleports", "displace": "Displaces", "spawn": "Spawns an Item", "spawnitemfromlist": "Spawns an Item",
    "spawnitematlocation": "Spawns an Item on tile", "summon": "Summons", "resurrection": "Resurrects a Monster", "corrupt": "Corrupts Artifacts",
    "sacrificeartifact": "Sacrifices an Artifact", "randomizeartifact": "Randomizes an Artifact",
    "cleanseartifact": "Cleanses Corruption from an Artifact", "vendingmachinesteal": "Steals from a Vending Machine",
    "stealitem": "Steals from Brax", "dig": "Destroys Walls", "create": "Creates a Wall", "rechargeanvil": "Recharges an Anvil of Krong",
    "grantxp": "Grants XP",
}
ELEMENT_NAMES = {"requirements": "Mana Cost", "buff": "Buff", "invisible": "Invisibility", "mute": "Prevents Casting", "polymorph": "Polymorph",
                 "targetHitEffectBuff": "Trigger", "crossbowShotBuff": "Trigger", "thrownBuff": "Trigger", "targetKillBuff": "Trigger",
                 "playerHitEffectBuff": "Trigger"}
# Which elements carry stats, the scale of a factor that names none, and the stat of a sight element (category, index).
DAMAGE_ELEMENTS, RESISTANCE_ELEMENTS = ["damagebuff", "damage", "weapon", "effect"], ["resistbuff", "resistances"]
DEFAULT_SCALE, SIGHT_RADIUS = ("secondary", "3"), ("secondary", "18")
# Trigger elements in reading order; those of effects go by the effect's type.
TRIGGERS = {
    "targetHitEffectBuff": "melee-target", "crossbowShotBuff": "crossbow-target", "thrownBuff": "thrown-target", "targetKillBuff": "kill-target",
    "playerHitEffectBuff": "melee-self", "dodgeBuff": "dodge", "criticalBuff": "critical", "counterBuff": "counter", "blockBuff": "block",
    "triggeroncast": "cast", "spell": "activated", "effect:trigger": "trigger-once", "effect:dot": "trigger-repeat", "effect:triggerfromlist": "trigger-list",
}
# ---- end of fixed values ----


def loose_integer(text: Column) -> Column:
    """The integer a text starts with, blanks skipped; null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def loose_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def or_default(value: Column, default) -> Column:
    """A missing value and zero both give way to the default."""
    return F.coalesce(F.when(value != 0, value), default if isinstance(default, Column) else F.lit(default).cast("bigint"))


def item_class(record: Column) -> Column:
    """Historical class of an item: the first rule that matches, the last one catches all."""
    weapon, armour = has_child(record, "weapon"), has_child(record, "armour")
    code, slot = attribute(record, "type"), child_attribute(record, "armour", "type")
    worn_as = attribute(record, "overrideClassName")
    named_weapon = lookup(WEAPON_NAMES, F.when(F.coalesce(code, F.lit("")) == "", "0").otherwise(code))
    plain_shield = (slot != "shield") | (F.coalesce(worn_as, F.lit("")) == "")
    named_armour = F.when(plain_shield, lookup(ARMOUR_NAMES, slot))
    food = F.get(children(record, "food"), 0)
    alchemical = F.coalesce(attribute(record, "alchemical"), F.lit("")) != ""
    result = F.when(weapon & named_weapon.isNotNull(), named_weapon).when(armour & named_armour.isNotNull(), named_armour)
    result = result.when(worn_as.isin("Orb", "Tome"), worn_as)
    result = result.when(F.coalesce(attribute(food, "hp"), F.lit("")) != "", "Food").when(F.coalesce(attribute(food, "mp"), F.lit("")) != "", "Booze")
    for tag, name in (("trap", "Trap"), ("wand", "Wand"), ("potion", "Potion"), ("mushroom", "Mushroom"), ("gem", "Gem")):
        result = result.when(has_child(record, tag), name)
    result = result.when(alchemical & has_child(record, "toolkit"), "Toolkit").when(alchemical, "Reagent")
    return result.when(armour & (slot == "sleeve"), "Armor (Sleeve)").when(weapon, "Weapon").when(armour, "Armour").otherwise("Item")


def chance(c: Column) -> Column:
    """Percent chance of an effect; a certain one has none."""
    text = F.coalesce(F.when(attribute(c, "percent") != "", attribute(c, "percent")), attribute(c, "percentage"))
    return F.when(text != "100", text)


def _effect(c: Column) -> Column:
    kind = F.when(c["tag"] == "effect", attribute(c, "type"))
    name = F.coalesce(lookup(EFFECT_NAMES, kind), lookup(ELEMENT_NAMES, c["tag"]))
    one_in = or_default(loose_integer(attribute(c, "amount")), 1)
    duration = (
        F.when(kind == "dot", attribute(c, "amount")).when(kind.isin("paralyze", "create"), attribute(c, "turns"))
        .when(c["tag"] == "buff", attribute(c, "time"))
    )
    amount = F.when(c["tag"] == "requirements", loose_number(attribute(c, "mp"))).when(
        kind.isin("heal", "spellpoints", "grantxp"), loose_number(attribute(c, "amount")))
    return F.struct(
        name.alias("name"), amount.alias("amount"), duration.alias("duration"),
        F.when(kind == "paralyze", F.floor(F.lit(100.0) / one_in + 0.5).cast("string")).otherwise(chance(c)).alias("chance"))


def spell_effects(record: Column) -> Column:
    """Named effects of a spell: of the spell itself, of its elements, and of those inside buffs."""
    def of_root(condition: Column, name: str, duration: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(condition, F.struct(F.lit(name).alias("name"), F.lit(None).cast("double").alias("amount"),
                                          (none if duration is None else duration).alias("duration"), none.alias("chance")))

    root = F.filter(F.array(
        of_root(attribute(record, "downtime").isNotNull(), "Cooldown", attribute(record, "downtime")),
        of_root(attribute(record, "attack") != "0", "Performs Melee Attack"), of_root(attribute(record, "type") == "template", "Affects Area"),
        of_root(attribute(record, "mine") == "1", "Mine", attribute(record, "mineTimer"))), lambda e: e.isNotNull())
    outer = F.transform(record["children"], _effect)
    inner = F.flatten(F.transform(record["children"], lambda c: F.transform(c["children"], _effect)))
    bleeding = F.transform(F.filter(record["children"], lambda c: (attribute(c, "bleed") == "1") & (attribute(c, "type") != "bleed")), lambda c: F.struct(
        F.lit("Starts Bleeding").alias("name"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("duration"), chance(c).alias("chance")))
    return F.filter(F.concat(root, outer, inner, bleeding), lambda e: e["name"].isNotNull())


_STAT = "array<struct<kind:string,source_key:string,amount:double,factor_kind:string,factor_key:string,factor:double>>"


def _stat(kind: str, key: Column, amount: Column, factor: Column | None = None, scale: tuple[Column, Column] | None = None) -> Column:
    none = F.lit(None).cast("string")
    scaled = F.lit(False) if factor is None else F.coalesce(factor != 0, F.lit(False))
    scale_kind, scale_key = scale or (none, none)
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("source_key"), amount.alias("amount"), F.when(scaled, scale_kind).alias("factor_kind"),
        F.when(scaled, scale_key).alias("factor_key"), F.when(scaled, F.lit(None).cast("double") if factor is None else factor).alias("factor"))


def stats(record: Column) -> Column:
    """Stats of a record and of the elements directly inside it, kind by kind.

    A damage amount may come with a factor (attribute name and ``F``), whose scale
    is the named primary stat, else the named secondary one, else magic power.
    Numbers are read loosely; an amount that is none is 0 for damage, else null.
    """
    def index(names: list[str], value: Column) -> Column:
        return F.when(value.isin(*[str(i) for i in range(len(names))]), value)

    def part(c: Column) -> Column:
        return F.struct(c["tag"].alias("tag"), c["attrs"].alias("attrs"))

    elements = F.concat(F.array(part(record)), F.transform(record["children"], part))

    def of(tags: list[str], read) -> Column:
        found = F.filter(elements, lambda e: e["tag"].isin(*tags))
        return F.flatten(F.transform(found, lambda e: F.filter(read(e).cast(_STAT), lambda s: s["kind"].isNotNull())))

    def keyed(read_key) -> Column:
        return F.transform(F.array(*[F.lit(k) for k in DAMAGE_KEYS]), read_key)

    def damage(e: Column) -> Column:
        primary, secondary = index(PRIMARY_STATS, attribute(e, "primaryScale")), index(SECONDARY_STATS, attribute(e, "secondaryScale"))
        scale = (F.when(primary.isNotNull(), "primary").when(secondary.isNotNull(), "secondary").otherwise(DEFAULT_SCALE[0]),
                 F.coalesce(primary, secondary, F.lit(DEFAULT_SCALE[1])))

        def one(key: Column) -> Column:
            amount, factor = loose_number(e["attrs"][key]), loose_number(e["attrs"][F.concat(key, F.lit("F"))])
            return F.when(amount.isNotNull() | factor.isNotNull(), _stat("damage", key, F.coalesce(amount, F.lit(0.0)), factor, scale))

        return F.filter(keyed(one), lambda s: s.isNotNull())

    def resistance(e: Column) -> Column:
        return F.filter(keyed(lambda key: F.when(F.coalesce(e["attrs"][key], F.lit("")) != "", _stat("resistance", key, loose_number(e["attrs"][key])))), lambda s: s.isNotNull())

    def indexed(kind: str, names: list[str]):
        def read(e: Column) -> Column:
            return F.filter(F.array(F.when(index(names, attribute(e, "id")).isNotNull(), _stat(kind, attribute(e, "id"), loose_number(attribute(e, "amount"))))), lambda s: s.isNotNull())
        return read

    return F.concat(
        of(DAMAGE_ELEMENTS, damage), of(RESISTANCE_ELEMENTS, resistance), of(["secondarybuff"], indexed("secondary", SECONDARY_STATS)),
        of(["primarybuff"], indexed("primary", PRIMARY_STATS)),
        of(["sightbuff"], lambda e: F.array(_stat(SIGHT_RADIUS[0], F.lit(SIGHT_RADIUS[1]), loose_number(attribute(e, "amount"))))))


def triggers(record: Column) -> Column:
    """Spell triggers of the elements directly inside a record, in the order of TRIGGERS; texts are kept as they are."""
    def given(c: Column, *names: str) -> Column:
        return F.coalesce(*[F.when(attribute(c, n) != "", attribute(c, n)) for n in names[:-1]], attribute(c, names[-1]))

    order = list(TRIGGERS)
    selector = lambda c: F.when(c["tag"] == "effect", F.concat(F.lit("effect:"), F.coalesce(attribute(c, "type"), F.lit("")))).otherwise(c["tag"])

    def read(c: Column, at: Column) -> Column:
        kind = attribute(c, "type")
        return F.struct(
            F.array_position(F.array(*[F.lit(t) for t in order]), selector(c)).alias("rank"), at.alias("at"), lookup(TRIGGERS, selector(c)).alias("kind"),
            given(c, "name", "spell").alias("spell"), given(c, "percent", "percentage").alias("chance"),
            F.when(kind == "trigger", attribute(c, "amount")).otherwise("0").alias("delay"), F.when(kind == "dot", attribute(c, "amount")).otherwise("0").alias("duration"),
            F.coalesce(attribute(c, "resistable") == "0", F.lit(False)).alias("unresistable"), attribute(c, "taxa").alias("taxonomy"))

    return F.sort_array(F.filter(F.transform(record["children"], read), lambda t: t["rank"] > 0))


def parse_monsters(records: DataFrame) -> DataFrame:
    """Monsters with loose numbers; a missing or zero depth is left to the parent."""
    record = F.col("record")
    return records.select(
        attribute(record, "name").alias("name"), child_attribute(record, "info", "text").alias("description"), attribute(record, "taxa").alias("taxonomy"),
        or_default(loose_integer(attribute(record, "level")) + 1, F.lit(None).cast("bigint")).alias("depth"),
        *[or_default(loose_integer(child_attribute(record, "stats", a)), 0).alias(n)
          for n, a in (("fighter", "numFig"), ("rogue", "numRog"), ("wizard", "numWiz"))],
        (attribute(record, "special") == "1").alias("special"), "parent_name")


def parse_crafts(records: DataFrame) -> DataFrame:
    """One row per output and stat that its tool trains."""
    record = F.col("record")
    rows = records.select(
        child_attribute(record, "tool", "tag").alias("tool"), F.coalesce(attribute(record, "hidden") == "1", F.lit(False)).alias("hidden"), "row_id",
        F.explode(children(record, "output")).alias("o"))
    return rows.select(
        "row_id", "tool", "hidden", attribute(F.col("o"), "name").alias("item"), or_default(loose_integer(attribute(F.col("o"), "amount")), 1).alias("amount"),
        loose_integer(attribute(F.col("o"), "skill")).alias("skill"), F.explode_outer(tool_stats(F.col("tool"))).alias("stat"))
