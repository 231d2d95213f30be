"""Numbers derived from levels and modifiers, and the rankings made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import code_unit_order

# ---- Fixed values: primary attributes (selector, weights of fighter, rogue, wizard levels) ----
PRIMARY = {
    "Burliness": ("0", 2, 1, 1), "Sagacity": ("1", 1, 1, 2), "Nimbleness": ("2", 1, 2, 1),
    "Caddishness": ("3", 2, 2, 1), "Stubbornness": ("4", 2, 1, 2), "Savvy": ("5", 1, 2, 2),
}
ARMOUR_KEYS = ["blasting", "crushing", "slashing"]
# ---- Fixed values: historical level stats: weights, constant and divisor; floors where divided ----
LEVEL_STATS = {
    "Burliness": (2, 1, 1, 0, 1), "Sagacity": (1, 1, 2, 0, 1), "Nimbleness": (1, 2, 1, 0, 1),
    "Caddishness": (2, 2, 1, 0, 1), "Stubborness": (2, 1, 2, 0, 1), "Savvy": (1, 2, 2, 0, 1),
    "Life": (4, 3, 2, 5, 1), "Mana": (2, 2, 4, 0, 1), "Melee Power": (2, 1, 1, -5, 3), "Magic Power": (1, 1, 2, 0, 2),
    "Crit": (2, 2, 1, 0, 2), "Haywire": (1, 2, 2, 0, 2), "Dodge": (1, 2, 1, 0, 2), "Enemy Dodge Reduction": (1, 2, 1, 0, 3), "Magic Resistance": (2, 1, 2, 0, 2),
}
HALVED_PAIRS = {"Block": ((2, 1, 1), (2, 1, 2)), "Counter": ((1, 2, 1), (2, 2, 1))}  # each sum over 6, then floored
SNEAKINESS = (2, 4, 3, 0.75, -20)
# ---- end of fixed values ----


def _weighted(fighter: Column, rogue: Column, wizard: Column, weights) -> Column:
    return fighter * weights[0] + rogue * weights[1] + wizard * weights[2]


def last_amount(modifiers: Column, kind: str, source_key: str) -> Column:
    """The last matching modifier decides; they do not add up."""
    hits = F.filter(modifiers, lambda m: (m["kind"] == kind) & (m["source_key"] == source_key))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["amount"], F.lit(0))


def primary_attributes(monsters: DataFrame) -> DataFrame:
    """Six rows per monster: base from levels, modifier, total."""
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("attribute"),
            _weighted(F.col("fighter"), F.col("rogue"), F.col("wizard"), weights).cast("double").alias("base"),
            last_amount(F.col("modifiers"), "primary", key).cast("double").alias("modifier"),
        )
        for label, (key, *weights) in PRIMARY.items()
    ])
    return monsters.select("id", F.explode(rows).alias("a")).select(
        "id", "a.attribute", "a.base", "a.modifier", (F.col("a.base") + F.col("a.modifier")).alias("total"))


def required_armour(monsters: DataFrame) -> DataFrame:
    """Armour that cancels a monster's plain hit; floors downward and may be negative."""
    levels = F.floor((F.col("fighter") * 2 + F.col("rogue") + F.col("wizard") - 5) / F.lit(3)).cast("bigint")
    plain = F.filter("modifiers", lambda m: (m["kind"] == "damage") & m["source_key"].isin(*ARMOUR_KEYS))
    damage = F.aggregate(plain, F.lit(0.0), lambda n, m: n + m["amount"])
    return monsters.select(
        "id", "name", levels.alias("archetype_contribution"), damage.alias("damage_modifiers"),
        (levels + damage).alias("required_armour"))


def rank_required_armour(monsters: DataFrame, limit: int = 10) -> DataFrame:
    return required_armour(monsters).orderBy(
        F.col("required_armour").desc(), code_unit_order(F.col("name")), code_unit_order(F.col("id"))).limit(limit)


def merge_stats(values: DataFrame, owner: list[str]) -> DataFrame:
    """Sum per stat and keep the place of its first appearance (``stat, amount, position``)."""
    return values.groupBy(*owner, "stat").agg(F.sum("amount").alias("amount"), F.min("position").alias("position"))


def inherit_stats(child: DataFrame, parent: DataFrame, owner: list[str]) -> DataFrame:
    """Parent values in parent order, replaced by the child's; new ones follow. ``place`` sorts them."""
    def placed(side: DataFrame, near: int) -> DataFrame:
        return side.select(*owner, "stat", "amount", F.struct(F.lit(near).alias("near"), F.col("position").cast("bigint").alias("position")).alias("place"))

    return placed(parent, 0).unionByName(placed(child, 1)).groupBy(*owner, "stat").agg(
        F.max_by("amount", "place").alias("amount"), F.min("place").alias("place"))


def level_stats(levels: DataFrame) -> DataFrame:
    """The 18 historical level stats of each owner (``id, fighter, rogue, wizard``)."""
    f, r, w = F.col("fighter"), F.col("rogue"), F.col("wizard")
    rows = []
    for position, (stat, (a, b, c, constant, divisor)) in enumerate(LEVEL_STATS.items()):
        total = _weighted(f, r, w, (a, b, c)) + constant
        value = total if divisor == 1 else F.floor(total / F.lit(divisor))
        rows.append(F.struct(F.lit(stat).alias("stat"), value.cast("bigint").alias("amount"), F.lit(position).alias("position")))
    for stat, (first, second) in HALVED_PAIRS.items():
        value = F.floor(_weighted(f, r, w, first) / F.lit(6.0) + _weighted(f, r, w, second) / F.lit(6.0))
        rows.append(F.struct(F.lit(stat).alias("stat"), value.cast("bigint").alias("amount"), F.lit(len(rows)).alias("position")))
    a, b, c, share, constant = SNEAKINESS
    sneak = F.floor(_weighted(f, r, w, (a, b, c)) * F.lit(share)) + constant
    rows.append(F.struct(F.lit("Sneakiness").alias("stat"), F.greatest(F.lit(0), sneak).cast("bigint").alias("amount"),
                         F.lit(len(rows)).alias("position")))
    return levels.select("id", F.explode(F.array(*rows)).alias("s")).select("id", "s.*")


def total_stats(bonus: DataFrame, levels: DataFrame) -> DataFrame:
    """Bonus stats first, level stats added to them or after them."""
    def placed(side: DataFrame, after: int) -> DataFrame:
        place = F.struct(F.lit(after).alias("after"), F.col("position").cast("bigint").alias("position"))
        return side.select("id", "stat", F.col("amount").cast("double").alias("amount"), place.alias("position"))

    return merge_stats(placed(bonus, 0).unionByName(placed(level_stats(levels), 1)), ["id"])


def historical_required_armour(monsters: DataFrame, totals: DataFrame, limit: int = 10) -> DataFrame:
    """Historical ranking over total stats; equal amounts keep declaration order."""
    levels = F.floor((F.col("fighter") * 2 + F.col("rogue") + F.col("wizard") - 5) / F.lit(3)).cast("double")
    damage = totals.filter(F.col("stat").isin(*ARMOUR_KEYS)).groupBy("id").agg(F.sum("amount").alias("_damage"))
    return monsters.join(damage, "id", "left").select(
        "id", "name", "record", (levels + F.coalesce("_damage", F.lit(0.0))).alias("amount")).orderBy(
        F.col("amount").desc(), "record").limit(limit)


def stat_search(uses: DataFrame, stat: str) -> DataFrame:
    """Historical stat search: owners of a stat by amount, largest first, per kind."""
    return uses.filter(F.col("stat") == stat).orderBy("owner_kind", F.col("amount").desc(), "record")
