"""Texts and classes shown for records: categories, labels, markers, icons, grids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexemes import SAFE_INTEGER, integer_or
from .records import attribute, attribute_key, child_attribute, children, has_child

# ---- Fixed values, equal to the catalogue's published texts and codes ----
WEAPON_CLASS = {
    "0": "weapon:sword", "1": "weapon:axe", "2": "weapon:mace", "3": "weapon:staff", "4": "weapon:crossbow",
    "5": "weapon:thrown", "6": "weapon:ammunition", "7": "weapon:dagger", "8": "weapon:polearm",
}
ARMOUR_SLOTS = ["head", "chest", "legs", "hands", "feet", "waist", "shield", "ring", "neck", "sleeve"]
CATEGORY_LABEL = {
    "weapon:sword": "Sword weapon", "weapon:axe": "Axe weapon", "weapon:mace": "Mace weapon",
    "weapon:staff": "Staff weapon", "weapon:crossbow": "Crossbow", "weapon:thrown": "Thrown weapon",
    "weapon:ammunition": "Ammunition", "weapon:dagger": "Dagger weapon", "weapon:polearm": "Polearm weapon",
    "weapon": "Weapon", "armour:head": "Head armour", "armour:chest": "Chest armour",
    "armour:legs": "Leg armour", "armour:hands": "Hand armour", "armour:feet": "Foot armour",
    "armour:waist": "Waist armour", "armour:shield": "Shield", "armour:ring": "Ring",
    "armour:neck": "Amulet", "armour:sleeve": "Armour sleeve", "armour": "Armour", "orb": "Orb",
    "tome": "Tome", "food": "Food", "booze": "Booze", "trap": "Trap", "wand": "Wand", "potion": "Potion",
    "mushroom": "Mushroom", "gem": "Gem", "toolkit": "Toolkit", "reagent": "Reagent", "item": "Item",
}
FLAG_LABEL = {
    "deprecated": "Deprecated", "friendlytaxa": "Friendly taxonomy", "nofood": "No food",
    "opendoors": "Opens doors", "storetheft": "Store theft", "veganism": "Veganism",
    "vmtheft": "Vending-machine theft",
}
EXPANSION_MARKER = {
    "official-expansion-1": "RotDG", "official-expansion-2": "YHTNTEP", "official-expansion-3": "CotW",
}
TRIGGER_LABEL = {
    "stepped-on": "When stepped on", "zapped": "When zapped", "quaffed": "When quaffed",
    "munched": "When munched", "item-hit": "When the item hits", "melee-target": "When you hit in melee",
    "crossbow-target": "When your bolt hits", "thrown-target": "When your thrown weapon hits",
    "kill-target": "When you kill an enemy", "melee-self": "When you are hit in melee",
    "dodge": "When you dodge", "critical": "When you critically hit", "counter": "When you counter",
    "block": "When you block", "cast": "When you cast a spell", "activated": "When activated",
    "eaten": "When eaten", "drunk": "When drunk", "trigger-once": "Triggered once",
    "trigger-repeat": "Repeated trigger", "trigger-list": "Triggered from a list",
}
MODIFIER_KINDS = ["damage", "resistance", "primary", "secondary"]
# ---- end of fixed values ----


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def item_category(record: Column) -> Column:
    """Class of an item by the shape of its record; the first shape that fits decides."""
    weapon = F.coalesce(lookup(WEAPON_CLASS, F.coalesce(attribute(record, "type"), F.lit("0"))), F.lit("weapon"))
    worn_as = F.lower(F.trim(attribute(record, "overrideClassName")))
    slot = F.lower(F.trim(child_attribute(record, "armour", "type")))
    armour = (
        F.when(worn_as.isin("orb", "tome"), worn_as)
        .when(slot.isin(*ARMOUR_SLOTS), F.concat(F.lit("armour:"), slot))
        .otherwise(F.lit("armour"))
    )
    food = children(record, "food")
    kind_text = F.trim(attribute(record, "type"))
    result = F.when(has_child(record, "weapon"), weapon).when(has_child(record, "armour"), armour)
    result = result.when(F.exists(food, lambda c: attribute(c, "hp").isNotNull()), F.lit("food"))
    result = result.when(F.exists(food, lambda c: attribute(c, "mp").isNotNull()), F.lit("booze"))
    result = result.when(F.size(food) > 0, F.lit("food"))
    for plain in ("trap", "wand", "potion", "mushroom", "gem", "toolkit"):
        result = result.when(has_child(record, plain), F.lit(plain))
    result = result.when(attribute(record, "alchemical").isNotNull(), F.lit("reagent"))
    named_type = (F.length(kind_text) > 0) & ~kind_text.rlike("^[0-9]+$")
    return result.when(named_type, attribute_key(record, "type")).otherwise(F.lit("item"))


def item_quality(record: Column) -> Column:
    trap_level = integer_or(child_attribute(record, "trap", "level"), 0, low=0)
    armour_level = integer_or(child_attribute(record, "armour", "level"), 0, low=0)
    weapon_level = integer_or(attribute(record, "level"), 0, low=0)
    return (
        F.when(has_child(record, "trap"), trap_level)
        .when(has_child(record, "armour"), armour_level)
        .when(has_child(record, "weapon"), weapon_level)
        .otherwise(F.lit(0).cast("bigint"))
    )


def title_words(text: Column, delimiters: str) -> Column:
    words = F.filter(F.split(text, delimiters), lambda w: w != "")
    return F.array_join(F.transform(words, _capital), " ")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def category_title(text: Column) -> Column:
    return title_words(text, "[-_: ]+")


def display_title(text: Column) -> Column:
    return title_words(text, r"[\s_-]+")


def item_category_label(category: Column) -> Column:
    title = category_title(category)
    return F.coalesce(lookup(CATEGORY_LABEL, category), F.when(title != "", title), F.lit("Item"))


def diagnostic_label(code: Column) -> Column:
    return F.regexp_replace(display_title(code), r"\bXml\b", "XML")


def flag_label(key: Column) -> Column:
    spaced = F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.split(spaced, "[-_ ]+"), _capital)
    return F.coalesce(lookup(FLAG_LABEL, F.lower(key)), F.array_join(words, " "))


def flag_value(value: Column) -> Column:
    return F.when(value == "1", "Enabled").when(value == "0", "Disabled").otherwise(value)


def source_marker(source_id: Column, kind: Column, label: Column) -> Column:
    words = F.regexp_extract_all(label, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    short = F.substring(letters, 1, 7)
    fallback = F.when(kind == "mod", "Mod").when(short != "", short).otherwise("Extra")
    return F.when(~kind.isin("base", "reference"), F.coalesce(lookup(EXPANSION_MARKER, source_id), fallback))


def stat_search_key(kind: Column, source_key: Column) -> Column:
    return F.concat_ws(":", F.lit("modifier"), kind, source_key)


def modifier_label(kind: Column, source_key: Column, stat_name: Column) -> Column:
    own = (
        F.when(kind == "damage", F.concat(display_title(source_key), F.lit(" damage")))
        .when(kind == "resistance", F.concat(display_title(source_key), F.lit(" resistance")))
        .when(kind == "primary", F.concat(F.lit("Primary attribute "), source_key))
        .when(kind == "secondary", F.concat(F.lit("Secondary stat "), source_key))
    )
    return F.coalesce(stat_name, own)


def plain_number(value: Column) -> Column:
    """Number text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def signed_value(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), plain_number(value))).otherwise(plain_number(value))


def trigger_label(kind: Column) -> Column:
    return lookup(TRIGGER_LABEL, kind)


def facet_label(key: Column) -> Column:
    """Label of a stat facet that no definition claims."""
    parts = F.split(key, ":")
    kind = F.get(parts, 1)
    source_key = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(3))), ":")
    selector = (F.get(parts, 0) == "modifier") & kind.isin(*MODIFIER_KINDS) & (source_key != "")
    return F.when(F.coalesce(selector, F.lit(False)), modifier_label(kind, source_key, F.lit(None).cast("string"))).otherwise(
        display_title(key)
    )


def asset_path(path: Column) -> Column:
    """Relative forward-slash path, or null when it could leave its root."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    return F.when((slashed != "") & ~asset_path_unsafe(path), slashed)


def asset_path_unsafe(path: Column) -> Column:
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    climbs = F.array_contains(F.split(slashed, "/"), "..")
    return F.coalesce(slashed.rlike("^/") | slashed.rlike("^[A-Za-z]:") | climbs, F.lit(False))


def is_sprite_wrapper(path: Column) -> Column:
    return F.lower(path).endswith(".xml")


def palette_is_file(name: Column) -> Column:
    return F.lower(name).endswith(".pal")


def encounter_group(special: Column, depth: Column) -> Column:
    return (
        F.when(special, "Special monster")
        .when(depth.isNull(), "Unknown dungeon depth")
        .otherwise(F.concat(F.lit("Dungeon level "), depth.cast("string")))
    )


def first_letter(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def listed(values: Column) -> Column:
    """Comma list of declared values, with a word for none and for unusable ones."""
    texts = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("Unavailable")))
    return F.when(F.size(values) == 0, "Not declared").otherwise(F.array_join(texts, ", "))


def listed_flags(values: Column) -> Column:
    return listed(F.transform(values, lambda v: F.when(v, "Yes").when(~v, "No")))


def charge_range(low: Column, high: Column) -> Column:
    def shown(end: Column) -> Column:
        return F.coalesce(end.cast("string"), F.lit("?"))

    return (
        F.when(low.isNull() & high.isNull(), "Unavailable")
        .when(low.eqNullSafe(high), low.cast("string"))
        .otherwise(F.concat(shown(low), F.lit("–"), shown(high)))
    )


def charge_ranges(ranges: Column) -> Column:
    texts = F.transform(ranges, lambda r: charge_range(r["minimum"], r["maximum"]))
    return F.when(F.size(ranges) == 0, "Not declared").otherwise(F.array_join(texts, ", "))


def lowest_level(levels: Column) -> Column:
    return F.coalesce(F.array_min(levels).cast("bigint"), F.lit(SAFE_INTEGER))


def rows_valid(rows: Column) -> Column:
    width = F.length(F.get(rows, 0))
    anchors = F.aggregate(rows, F.lit(0), lambda n, r: n + F.regexp_count(r, F.lit("#")))
    shaped = F.forall(rows, lambda r: r.rlike("^[.@#]+$") & (F.length(r) == width))
    return (F.size(rows) == 0) | (F.coalesce(shaped, F.lit(False)) & (anchors == 1))


def rows_summary(rows: Column, affects_anchor: Column) -> Column:
    touched = F.aggregate(
        rows,
        F.lit(0),
        lambda n, r: n
        + F.regexp_count(r, F.lit("@"))
        + F.when(affects_anchor, F.regexp_count(r, F.lit("#"))).otherwise(F.lit(0)),
    )
    return F.struct(
        F.size(rows).alias("row_count"),
        F.coalesce(F.length(F.get(rows, 0)), F.lit(0)).alias("column_count"),
        touched.alias("affected_tiles"),
    )


def drop_valid(chance: Column, drop_type: Column, item_key: Column, item_name: Column, item_id: Column) -> Column:
    in_range = chance.isNotNull() & (chance == F.floor(chance)) & chance.between(0, 100)
    typed = drop_type.isNotNull() & item_key.isNull() & item_name.isNull() & item_id.isNull()
    named_drop = drop_type.isNull() & item_key.isNotNull() & item_name.isNotNull()
    return F.coalesce(in_range, F.lit(False)) & (typed | named_drop)
