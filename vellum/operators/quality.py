"""Integrity rules as rows: every violation is reported, nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import MODIFIER_KINDS, TRIGGER_LABEL, drop_valid, rows_valid
from ..functions.lexemes import SAFE_INTEGER

# ---- Fixed values: enumerations that columns are held to ----
KINDS = ["item", "recipe", "encrustment", "skill", "ability", "spell", "monster", "stat", "template"]
SOURCE_KINDS = ["base", "expansion", "mod", "fixture", "reference"]
SEVERITIES = ["info", "warning", "error"]
DAMAGE_KEYS = [
    "acidic", "aethereal", "asphyxiative", "blasting", "conflagratory", "crushing", "existential", "hyperborean",
    "necromantic", "piercing", "putrefying", "righteous", "slashing", "toxic", "transmutative", "voltaic",
]
ITEM_TRIGGERS = list(TRIGGER_LABEL)
TRAP_MODES = ["always", "once"]
RECOVERIES = ["life", "mana"]
# ---- end of fixed values ----


def repeated(table: DataFrame, key: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit(rule).alias("rule"), F.concat_ws(":", *key).alias("subject"), "n")


def contested_routes(routes: DataFrame) -> DataFrame:
    """(kind, route) owned by more than one record (``kind, route, id``)."""
    return routes.groupBy("kind", "route").agg(F.count_distinct("id").alias("owners")).filter("owners > 1")


def modifier_stat_issues(modifiers: DataFrame, stats: DataFrame) -> DataFrame:
    """Linked modifiers whose stat is missing or claims another selector."""
    known = stats.select(F.col("id").alias("stat_id"), F.col("modifier_kind").alias("_kind"), F.col("source_key").alias("_key"),
                         F.lit(True).alias("_known"))
    joined = modifiers.filter("stat_id is not null").join(known, "stat_id", "left")
    same = F.col("modifier_kind").eqNullSafe(F.col("_kind")) & F.col("source_key").eqNullSafe(F.col("_key"))
    problem = F.when(F.col("_known").isNull(), "stat missing").when(~same, "selector differs")
    return joined.withColumn("problem", problem).filter("problem is not null").drop("_kind", "_key", "_known")


def count_mismatches(diagnostics: DataFrame, stored: DataFrame) -> DataFrame:
    """Severities whose stored count is not the real one (``severity, n``)."""
    found = diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("found"))
    joined = stored.join(found, "severity", "full_outer").select(
        "severity", F.coalesce("n", F.lit(0)).alias("stored"), F.coalesce("found", F.lit(0)).alias("found"))
    return joined.filter("stored <> found")


def missing_diagnostics(references: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Diagnostic ids that entities carry but no diagnostic has."""
    return references.join(diagnostics.select(F.col("id").alias("diagnostic_id")), "diagnostic_id", "left_anti")


def rule_violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass: a rule must not be false; an unknown value counts as broken."""
    sums = table.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    return sums.select(F.explode(entries).alias("e")).select("e.rule", "e.violations")


def violating_rows(table: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key, rule) for each broken rule of each row."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]),
                      lambda name: name.isNotNull())
    return table.select(*key, F.explode(broken).alias("rule"))


def none_or(value: Column, rule: Column) -> Column:
    return value.isNull() | F.coalesce(rule, F.lit(False))


def both_or_neither(left: Column, right: Column) -> Column:
    return left.isNull() == right.isNull()


def requires(dependent: Column, base: Column) -> Column:
    return dependent.isNull() | base.isNotNull()


def safe_integer(value: Column, low: int | None = None, high: int | None = None) -> Column:
    rule = F.abs(value) <= SAFE_INTEGER
    if low is not None:
        rule = rule & (value >= low)
    if high is not None:
        rule = rule & (value <= high)
    return rule


def non_blank(value: Column) -> Column:
    return F.length(F.trim(value)) > 0


def rules_for(kind: str) -> dict[str, Column]:
    """The column rules of stored records, per kind; ``common`` holds for every kind."""
    c = F.col
    rules = {
        "common": {
            "kind is known": c("kind").isin(*KINDS),
            "id is kind and key": c("id") == F.concat_ws(":", c("kind"), c("canonical_key")),
            "name is declared": non_blank(c("name")),
            "slug is declared": F.length(c("slug")) > 0,
            "line counts from one": safe_integer(c("line"), 1),
            "column counts from one": safe_integer(c("column"), 1),
        },
        "source": {
            "source kind is known": c("kind").isin(*SOURCE_KINDS),
            "source id is declared": F.length(c("id")) > 0,
            "precedence is an integer": safe_integer(c("precedence")),
        },
        "item": {
            "price is a count": none_or(c("price"), safe_integer(c("price"), 0)),
            "quality is a count": safe_integer(c("quality"), 0),
            "charges are ordered": F.forall("charge_ranges", lambda r: requires(r["minimum"], r["minimum"]) & (
                r["minimum"].isNull() | r["maximum"].isNull() | (r["minimum"] <= r["maximum"]))),
            "recovery resource is known": F.forall("recoveries", lambda r: r["resource"].isin(*RECOVERIES)),
            "trap mode is known": F.forall("traps", lambda t: none_or(t["activation"], t["activation"].isin(*TRAP_MODES))),
            "macguffin spell is whole": F.forall("macguffins", lambda m: both_or_neither(m["spell_key"], m["spell_name"])),
            "trigger kind is known": F.forall("triggers", lambda t: t["kind"].isin(*ITEM_TRIGGERS)),
            "modifier kind is known": F.forall("modifiers", lambda m: m["kind"].isin(*MODIFIER_KINDS)),
        },
        "recipe": {
            "skill level is a count": safe_integer(c("skill_level"), 0),
            "input amounts are positive": F.forall("inputs", lambda i: safe_integer(i["amount"], 1)),
            "output amounts are positive": F.forall("outputs", lambda o: safe_integer(o["amount"], 1)),
            "output skills are counts": F.forall("outputs", lambda o: safe_integer(o["skill_level"], 0)),
        },
        "encrustment": {
            "skill level is a count": safe_integer(c("skill_level"), 0),
            "power chance is a share": F.forall("powers", lambda p: none_or(p["chance"], p["chance"].between(0, 1))),
            "modifier kind is known": F.forall("modifiers", lambda m: m["kind"].isin(*MODIFIER_KINDS)),
        },
        "monster": {
            "level is a count": safe_integer(c("level"), 0),
            "depth follows level": none_or(c("depth"), safe_integer(c("depth"), 1)),
            "drops are well formed": F.forall("drops", lambda d: drop_valid(
                d["chance"], d["drop_type"], d["item_key"], d["item_name"], d["item_id"])),
            "parent is whole": both_or_neither(c("inherits_key"), c("inherits_name")),
            "parent id needs a key": requires(c("inherits_id"), c("inherits_key")),
        },
        "stat": {
            "selector is whole": both_or_neither(c("modifier_kind"), c("source_key")),
            "selector kind is known": none_or(c("modifier_kind"), c("modifier_kind").isin(*MODIFIER_KINDS)),
        },
        "template": {"rows form a grid": rows_valid(c("rows"))},
        "diagnostic": {
            "severity is known": c("severity").isin(*SEVERITIES),
            "code is declared": F.length(c("code")) > 0,
            "message is declared": F.length(c("message")) > 0,
        },
    }
    return rules[kind]


# ---- input files ----------------------------------------------------------------

def manifest_issues(sources: DataFrame, assets: DataFrame, patches: DataFrame, headers: DataFrame) -> DataFrame:
    """Declarations that occur twice, and registries declared out of order."""
    found = repeated(sources, ["manifest", "id"], "source declared twice").unionByName(
        repeated(assets, ["manifest", "source_id", "id"], "asset declared twice")).unionByName(
        repeated(patches, ["manifest", "path"], "patch declared twice"))
    previous, current = F.col("previous_registry"), F.col("registry")
    lacking = previous.isNotNull() & current.isNull()
    problem = F.when(lacking, "previous registry without a current one").when(previous == current, "registries are one file")
    headers = headers.withColumn("rule", problem).filter("rule is not null").select(
        "rule", F.col("manifest").cast("string").alias("subject"), F.lit(1).cast("bigint").alias("n"))
    return found.unionByName(headers)


def outcome_issues(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Keys that do not have exactly one outcome, and outcomes that nothing expects."""
    wanted = expected.select("kind", "entity_id").distinct().withColumn("_wanted", F.lit(True))
    found = outcomes.groupBy("kind", "entity_id").agg(F.count(F.lit(1)).alias("outcomes"))
    joined = wanted.join(found, ["kind", "entity_id"], "full_outer")
    problem = (
        F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("outcomes").isNull(), "missing")
        .when(F.col("outcomes") > 1, "repeated")
    )
    return joined.select("kind", "entity_id", F.coalesce("outcomes", F.lit(0)).alias("outcomes"), problem.alias("problem")).filter(
        "problem is not null")
