"""Declared inputs: manifests, patches, registries, the reference stats and the input inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import canonical_key, code_unit_order
from ..functions.labels import MODIFIER_KINDS, asset_path_unsafe
from ..operators.quality import DAMAGE_KEYS, KINDS, SOURCE_KINDS

# ---- Fixed values: input schemas, database kinds, and the project's 62 reference stats ----
DATABASE_KINDS = ["items", "recipes", "encrustments", "skills", "spells", "monsters", "templates", "stats"]
UNVERSIONED = "unversioned"
MANIFEST = """schemaVersion INT, datasetId STRING, datasetVersion STRING, routeRegistry STRING, previousRouteRegistry STRING,
  sources ARRAY<STRUCT<id: STRING, label: STRING, kind: STRING, version: STRING, precedence: INT, root: STRING, rootBase: STRING,
    files: ARRAY<STRUCT<kind: STRING, path: STRING>>, presentedAssets: ARRAY<STRUCT<id: STRING, path: STRING>>>>,
  patches ARRAY<STRUCT<`order`: INT, path: STRING>>"""
PATCH = """schemaVersion INT, id STRING, reason STRING,
  appliesTo STRUCT<datasetId: STRING, datasetVersion: STRING, sourceId: STRING, sourceVersion: STRING>, operations ARRAY<STRING>"""
REGISTRY = """schemaVersion INT, datasetId STRING, datasetVersion STRING, lineage STRUCT<type: STRING, datasetVersion: STRING, sha256: STRING>,
  entries ARRAY<STRUCT<entityKind: STRING, target: STRUCT<type: STRING, entityId: STRING, sourceId: STRING, originalId: STRING>,
    status: STRING, canonicalSlug: STRING, aliases: ARRAY<STRING>>>"""
PRIMARY_STATS = ["Burliness", "Sagacity", "Nimbleness", "Caddishness", "Stubbornness", "Savvy"]
SECONDARY_STATS = [
    "Life", "Mana", "Melee Power", "Magic Power", "Critical Chance", "Haywire Chance", "Dodge Chance", "Block Chance", "Counter Chance",
    "Enemy Dodge Reduction", "Armour Absorption", "Magic Resistance", "Sneakiness", "Life Regeneration", "Mana Regeneration", "Wand Affinity",
    "Trap Affinity", "Trap Sight Radius", "Sight Radius", "Smithing", "Tinkering", "Alchemy", "Magic Reflection", "Wand Crafting",
]
# ---- end of fixed values ----


def load_manifests(texts: DataFrame) -> DataFrame:
    """Manifests (``manifest, json``) with version 1 lifted to version 2."""
    read = texts.select("manifest", F.from_json("json", MANIFEST).alias("m"))
    lifted = F.transform("m.sources", lambda s: F.when(F.col("m.schemaVersion") == 1, s.withField("version", F.lit(UNVERSIONED))).otherwise(s))
    return read.select(
        "manifest", F.col("m.datasetId").alias("dataset_id"),
        F.when(F.col("m.schemaVersion") == 1, UNVERSIONED).otherwise(F.col("m.datasetVersion")).alias("dataset_version"),
        lifted.alias("sources"), F.col("m.patches").alias("patches"), F.col("m.routeRegistry").alias("registry"),
        F.col("m.previousRouteRegistry").alias("previous_registry"))


def migrate_manifests(texts: DataFrame, dataset_version: str, source_version: str) -> DataFrame:
    """Version 1 manifests as version 2 with the caller's versions."""
    loaded = load_manifests(texts)
    return loaded.withColumn("dataset_version", F.lit(dataset_version)).withColumn(
        "sources", F.transform("sources", lambda s: s.withField("version", F.lit(source_version))))


def declared_sources(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("manifest", F.explode("sources").alias("s"))
    return rows.select("manifest", "s.id", "s.label", "s.kind", "s.version", "s.precedence", "s.root")


def declared_files(manifests: DataFrame) -> DataFrame:
    """(manifest, source, precedence, kind, path) for each database file, with the path rule checked."""
    rows = manifests.select("manifest", F.explode("sources").alias("s")).select("manifest", "s", F.explode("s.files").alias("f"))
    return rows.select(
        "manifest", F.col("s.id").alias("source_id"), F.col("s.precedence").alias("precedence"), F.col("f.kind").alias("kind"),
        F.concat_ws("/", "s.root", "f.path").alias("path"),
        (~asset_path_unsafe(F.col("f.path")) & F.col("f.kind").isin(*DATABASE_KINDS)).alias("valid"))


def declared_assets(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("manifest", F.explode("sources").alias("s"))
    return rows.select("manifest", F.col("s.id").alias("source_id"), F.explode("s.presentedAssets").alias("a")).select(
        "manifest", "source_id", "a.id", "a.path")


def source_rules(sources: DataFrame) -> DataFrame:
    """Sources with an unknown kind or a missing id."""
    return sources.filter(~F.col("kind").isin(*SOURCE_KINDS) | (F.coalesce(F.col("id"), F.lit("")) == ""))


def read_patches(texts: DataFrame) -> DataFrame:
    """Operations of patch files (``file, json``); values stay JSON text."""
    read = texts.select("file", F.from_json("json", PATCH).alias("p"))
    rows = read.select("file", "p", F.posexplode("p.operations").alias("op_index", "op"))

    def part(name: str) -> Column:
        return F.get_json_object("op", f"$.{name}")

    def raw(name: str) -> Column:
        value = F.try_variant_get(F.try_parse_json("op"), f"$.{name}", "variant")
        return F.coalesce(F.to_json(value), F.lit("null"))

    return rows.select(
        F.col("p.id").alias("patch_id"), "file", "op_index", F.col("p.appliesTo.sourceId").alias("patch_source"), part("entityKind").alias("kind"),
        part("canonicalKey").alias("canonical_key"), part("field").alias("field"), raw("expectedValue").alias("expected"), raw("value").alias("value"))


def patch_file_issues(operations: DataFrame) -> DataFrame:
    """Rules a patch file must meet: a kebab id, known kinds, keys already canonical, one operation per field."""
    simple = operations.select(
        "patch_id", "op_index",
        F.when(~F.col("patch_id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "id is not kebab case")
        .when(~F.col("kind").isin(*KINDS), "kind is unknown")
        .when(canonical_key(F.col("canonical_key")) != F.col("canonical_key"), "key is not canonical").alias("rule")).filter("rule is not null")
    twice = operations.groupBy("patch_id", "kind", "canonical_key", "field").agg(
        F.count(F.lit(1)).alias("n"), F.max("op_index").alias("op_index")).filter("n > 1")
    return simple.unionByName(twice.select("patch_id", "op_index", F.lit("field changed twice").alias("rule")))


def read_registries(texts: DataFrame) -> DataFrame:
    """Entries of registry files (``file, json``); the status of version 1 entries is active."""
    read = texts.select("file", F.from_json("json", REGISTRY).alias("r"))
    rows = read.select("file", F.posexplode("r.entries").alias("entry_index", "e"))
    return rows.select(
        "file", "entry_index", F.col("e.entityKind").alias("kind"), F.col("e.target.type").alias("target_type"),
        F.col("e.target.entityId").alias("target_entity"), F.col("e.target.sourceId").alias("target_source"),
        F.col("e.target.originalId").alias("target_original"), F.coalesce("e.status", F.lit("active")).alias("status"),
        F.col("e.canonicalSlug").alias("canonical_slug"), F.col("e.aliases").alias("aliases"))


def reference_stats(spark: SparkSession) -> DataFrame:
    """The project's own stat table, a source of its own: 16 damage, 16 resistance, 6 primary and 24 secondary stats."""
    keyed = [(kind, key, f"{key.capitalize()} {kind.capitalize()}") for kind in MODIFIER_KINDS[:2] for key in DAMAGE_KEYS]
    indexed = [("primary", str(i), n) for i, n in enumerate(PRIMARY_STATS)] + [("secondary", str(i), n) for i, n in enumerate(SECONDARY_STATS)]
    rows = [(f"stat:{name.lower()}", name.lower(), name, kind, kind, key, f"{kind}-{key}") for kind, key, name in keyed + indexed]
    return spark.createDataFrame(
        rows, "id string, canonical_key string, name string, stat_group string, modifier_kind string, source_key string, original_id string")


def inventory(inputs: DataFrame) -> DataFrame:
    """One row per display path (``file, path, content``) with digest and size."""
    content = F.col("content")
    return inputs.select("file", "path", F.sha2(content.cast("binary"), 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def inventory_conflicts(registered: DataFrame) -> DataFrame:
    """Display paths that stand for more than one real file."""
    return registered.groupBy("file").agg(F.count_distinct("path").alias("paths")).filter("paths > 1")


def load_order(files: DataFrame) -> DataFrame:
    """Files in the order they are read: by precedence and id of their source, then path and kind."""
    return files.orderBy("manifest", "precedence", code_unit_order(F.col("source_id")), code_unit_order(F.col("path")), "kind")


def declared_patches(manifests: DataFrame) -> DataFrame:
    """(manifest, order, path, rank): patch files in the order in which they apply."""
    listed = F.array_sort("patches", lambda a, b: F.when(a["order"] != b["order"], a["order"] - b["order"]).when(
        code_unit_order(a["path"]) < code_unit_order(b["path"]), -1).when(code_unit_order(a["path"]) > code_unit_order(b["path"]), 1).otherwise(0))
    rows = manifests.select("manifest", F.posexplode(listed).alias("rank", "p"))
    return rows.select("manifest", "p.order", "p.path", F.col("rank").cast("bigint").alias("rank"))


def repeated_patch_ids(patches: DataFrame) -> DataFrame:
    """Ids that several patch files of one manifest (``manifest, path, patch_id``) have."""
    return patches.groupBy("manifest", "patch_id").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def active_sources(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sources that are required or switched on (``id, active``); their own default counts where nothing is chosen."""
    joined = sources.join(chosen.select("id", F.col("active").alias("_chosen")), "id", "left")
    return joined.filter(F.col("required") | F.coalesce("_chosen", "active_by_default")).drop("_chosen")


def file_audit(files: DataFrame) -> DataFrame:
    """Number and bytes of files per extension (``path, bytes``)."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    named = files.withColumn("extension", F.when(extension != "", extension).otherwise("[none]"))
    return named.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("files"))


def xml_audit(parsed: DataFrame) -> DataFrame:
    """Valid and invalid files and number of records, per database kind."""
    per_file = parsed.groupBy("kind", "source_id", "file").agg(F.max("problem").alias("problem"), F.count("record").alias("records"))
    return per_file.groupBy("kind").agg(
        F.count_if(F.col("problem").isNull()).alias("valid"), F.count_if(F.col("problem").isNotNull()).alias("invalid"),
        F.sum("records").alias("records"))
