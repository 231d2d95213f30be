"""Merge, history, diagnostics, patches, routes and registry over the test tables."""

from pyspark.sql import functions as F

from ..functions.keys import canonical_key, entity_id, route_matches, slugify
from ..operators import diagnostics, merge, patching, quality, reports, route_log, routing
from ..operators.linking import alias_table
from . import views  # noqa: F401
from .registry import VIEWS, query, source, table

FIELDS = ["name", "description", "category", "price", "quality"]


def candidates(spark, sf):
    raw = source(spark, sf, "candidates_v")
    return raw.select(
        "kind", canonical_key(F.col("name")).alias("canonical_key"), "part", *FIELDS, "precedence", "source_id", "file", "line",
        F.col("col").alias("column"), F.col("name").alias("original_name"), "original_id")


VIEWS["ordered_v"] = """
SELECT *, row_number() OVER w AS position, lag(name) OVER w AS p_name0, lag(description) OVER w AS p_description,
  lag(category) OVER w AS p_category, lag(price) OVER w AS p_price, lag(quality) OVER w AS p_quality, lag(line) OVER w AS p_line,
  lag(source_id) OVER w AS p_source, lead(line) OVER w IS NULL AS is_last
FROM candidates_v WINDOW w AS (PARTITION BY lowered ORDER BY precedence, source_id, file, line)"""
VIEWS["winners_v"] = "SELECT * FROM ordered_v WHERE is_last"


@query("W01_winner", "SELECT lowered AS canonical_key, part, source_id, precedence, price, position AS variant_count FROM winners_v")
def winner(spark, sf):
    return merge.resolve(candidates(spark, sf), FIELDS).select(
        "canonical_key", "part", "source_id", "precedence", "price", "variant_count")


CHANGED = """array_to_string(list_filter([CASE WHEN category IS DISTINCT FROM p_category THEN 'category' END,
  CASE WHEN description IS DISTINCT FROM p_description THEN 'description' END, CASE WHEN name IS DISTINCT FROM p_name0 THEN 'name' END,
  CASE WHEN price IS DISTINCT FROM p_price THEN 'price' END, CASE WHEN quality IS DISTINCT FROM p_quality THEN 'quality' END],
  lambda c: c IS NOT NULL), ',')"""


@query("W02_history", "SELECT lowered AS canonical_key, position, line, p_line AS previous_line, p_source AS previous_source FROM ordered_v")
def history(spark, sf):
    return merge.history(candidates(spark, sf), FIELDS).select(
        "canonical_key", "position", F.col("provenance.line").alias("line"), F.col("previous.line").alias("previous_line"),
        F.col("previous.source_id").alias("previous_source"))


@query("W03_changed_fields", f"SELECT lowered AS canonical_key, line, {CHANGED} AS changed FROM ordered_v WHERE position > 1")
def changed(spark, sf):
    steps = merge.override_steps(merge.history(candidates(spark, sf), FIELDS))
    return steps.select("canonical_key", F.col("provenance.line").alias("line"), F.array_join("changed_fields", ",").alias("changed"))


@query("W12_last_by_name", """
SELECT name, arg_max(part, CAST(precedence AS BIGINT) * 1000000000 + line) AS part FROM candidates_v GROUP BY name""")
def last_by_name(spark, sf):
    rows = candidates(spark, sf).select("name", "part", "precedence", "line")
    return merge.last_by_name(rows, "name", ["precedence", "line"]).select("name", "part")


@query("N41_append_collections", """
SELECT kind, id, name, category FROM entities_v""")
def append_collections(spark, sf):
    entities = source(spark, sf, "entities_v").select("kind", "id", "name", "category")
    return merge.append_collections(*[entities.filter(F.col("kind") == k) for k in quality.KINDS])


@query("U02_all_entities", "SELECT kind, id, name, source_id, line FROM entities_v")
def all_entities(spark, sf):
    entities = source(spark, sf, "entities_v").select("kind", "id", "name", "source_id", "line")
    return merge.append_collections(*[entities.filter(F.col("kind") == k) for k in quality.KINDS])


@query("U03_distinct_keys", """
SELECT lowered AS canonical_key, count(DISTINCT source_id) AS source_count, count(DISTINCT original_id) AS id_count FROM candidates_v GROUP BY lowered""")
def distinct_keys(spark, sf):
    return candidates(spark, sf).groupBy("canonical_key").agg(
        F.count_distinct("source_id").alias("source_count"), F.count_distinct("original_id").alias("id_count"))


# ---- entities with routes ---------------------------------------------------------

def merged(spark, sf):
    return merge.resolve(candidates(spark, sf), FIELDS).withColumn("id", F.concat_ws(":", "kind", "canonical_key"))


def variants(spark, sf):
    steps = merge.history(candidates(spark, sf), FIELDS)
    return steps.select("kind", "canonical_key", F.concat_ws(":", "kind", "canonical_key").alias("id"), "position",
                        "provenance.source_id", "provenance.original_id", "provenance.original_name")


@query("J01_aliases_for", """
SELECT 'item' AS kind, alias, arg_max(id, lowered || chr(1) || lpad(CAST(step AS VARCHAR), 12, '0')) AS target_id FROM (
  SELECT lowered, 'item:' || lowered AS id, lowered AS alias, 0 AS step FROM winners_v
  UNION ALL SELECT lowered, 'item:' || lowered, lower(original_id), position * 2 - 1 FROM ordered_v
  UNION ALL SELECT lowered, 'item:' || lowered, lowered, position * 2 FROM ordered_v) GROUP BY alias""")
def aliases_for(spark, sf):
    return alias_table(merged(spark, sf).select("kind", "id", "canonical_key"), variants(spark, sf))


def reservations(spark, sf):
    """Every tenth merged name is pinned by its number; it also holds one alias."""
    return merged(spark, sf).filter("part % 10 = 0").select(
        "kind", "id", F.concat(F.lit("pinned-"), F.col("part").cast("string")).alias("canonical_slug"),
        F.array(F.concat(F.lit("held-"), F.col("part").cast("string"))).alias("aliases"))


def protected(spark, sf):
    """Slugs of retired records: those of names whose winner is a multiple of seven."""
    return merged(spark, sf).filter("part % 7 = 0").select("kind", slugify(F.col("name")).alias("slug"))


SQL_SLUGGED = """regexp_replace(regexp_replace(lowered, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"""
VIEWS["based_v"] = f"SELECT *, {SQL_SLUGGED} AS base_slug, part % 10 = 0 AS pinned, part % 7 = 0 AS shielded FROM winners_v"
VIEWS["shields_v"] = "SELECT DISTINCT base_slug FROM based_v WHERE shielded"
VIEWS["allocated_v"] = """
SELECT lowered, part, base_slug, pinned, original_id,
  CASE WHEN pinned THEN 'pinned-' || part
    WHEN row_number() OVER (PARTITION BY base_slug, pinned ORDER BY lowered) = 1 AND base_slug NOT IN (SELECT base_slug FROM shields_v) THEN base_slug
    ELSE base_slug || '-' || lower(to_base(list_reduce(list_prepend(2166136261::UBIGINT,
      list_transform(string_split('item:' || lowered, ''), lambda c: ord(c)::UBIGINT)),
      lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)::BIGINT, 36, 7)) END AS slug
FROM based_v"""


def allocated(spark, sf):
    entities = merged(spark, sf).select("kind", "id", "canonical_key", "name")
    return routing.allocate_slugs(entities, reservations(spark, sf), protected(spark, sf))


@query("W04_allocate_slugs", """
SELECT 'item:' || lowered AS id, slug, CASE WHEN pinned THEN 'reserved' WHEN slug = base_slug THEN 'base' ELSE 'suffixed' END AS decision
FROM allocated_v""")
def allocate_slugs(spark, sf):
    return allocated(spark, sf).select("id", "slug", "decision")


def claims(spark, sf, routed):
    requested = merged(spark, sf).select("kind", "id", F.explode(F.array(
        F.concat(F.lit("b-"), F.expr("part % 30").cast("string")), F.concat(F.lit("held-"), F.expr("part - part % 10").cast("string")),
    )).alias("alias"))
    return routing.alias_claims(routed, requested, variants(spark, sf))


VIEWS["claims_v"] = """
SELECT DISTINCT c.alias, c.lowered FROM (
  SELECT 'b-' || CAST(part % 30 AS VARCHAR) AS alias, lowered FROM winners_v
  UNION ALL SELECT 'held-' || CAST(part - part % 10 AS VARCHAR), lowered FROM winners_v
  UNION ALL SELECT lower(original_id), lowered FROM ordered_v) c JOIN allocated_v a USING (lowered) WHERE c.alias <> a.slug"""
SQL_DECIDED = """
SELECT c.alias, 'item:' || c.lowered AS id, n.claimants, CASE WHEN r.lowered = c.lowered THEN 'registry' WHEN r.lowered IS NOT NULL THEN 'conflict-registry'
  WHEN c.alias IN (SELECT base_slug FROM shields_v) THEN 'conflict-protected'
  WHEN n.claimants = 1 AND c.alias NOT IN (SELECT slug FROM allocated_v) THEN 'kept' ELSE 'conflict' END AS outcome
FROM claims_v c JOIN (SELECT alias, count(*) AS claimants FROM claims_v GROUP BY alias) n USING (alias)
LEFT JOIN (SELECT 'held-' || CAST(part AS VARCHAR) AS alias, lowered FROM allocated_v WHERE pinned) r ON r.alias = c.alias"""


@query("W05_alias_conflicts", SQL_DECIDED)
def alias_conflicts(spark, sf):
    routed = allocated(spark, sf)
    decided = routing.decide_aliases(claims(spark, sf, routed), routed, reservations(spark, sf), protected(spark, sf))
    return decided.select("alias", "id", "claimants", "outcome")


@query("P03_route_match", """
SELECT 'item:' || lowered AS id, part FROM allocated_v WHERE slug = 'red-widget' OR lower(original_id) = 'p-7'""")
def route_match(spark, sf):
    routed = allocated(spark, sf).join(merged(spark, sf).select("id", "part", "original_id"), "id")
    hit = route_matches(F.col("slug"), F.array(slugify(F.col("original_id"))), F.lit("red-widget")) | route_matches(
        F.col("slug"), F.array(slugify(F.col("original_id"))), F.lit("p-7"))
    return routed.filter(hit).select("id", "part")


# ---- registry -----------------------------------------------------------------------

def registry_entries(spark, sf):
    """An entry for every part: by source id or entity id, some retired, some pointing nowhere."""
    p = source(spark, sf, "candidates_v")
    target = F.when(F.expr("part % 4 = 0"), F.lit("entity-id")).otherwise("source-id")
    return p.select(
        F.col("part").alias("entry_index"), "kind", target.alias("target_type"),
        F.when(target == "entity-id", F.concat(F.lit("item:"), F.col("lowered"))).alias("target_entity"),
        F.when(target == "source-id", F.col("source_id")).alias("target_source"),
        F.when(target == "source-id", F.expr("CASE WHEN part % 3 = 0 THEN 'gone' ELSE original_id END")).alias("target_original"),
        F.expr("CASE WHEN part % 5 = 0 THEN 'tombstone' ELSE 'active' END").alias("status"),
        F.concat(F.lit("slug-"), F.col("part").cast("string")).alias("canonical_slug"),
        F.array(F.concat(F.lit("old-"), F.col("part").cast("string"))).alias("aliases"))


VIEWS["entries_v"] = """
SELECT part AS entry_index, CASE WHEN part % 4 = 0 THEN 'item:' || lowered END AS target_entity, part % 4 <> 0 AS by_source, source_id AS target_source,
  CASE WHEN part % 3 = 0 THEN 'gone' ELSE original_id END AS target_original, CASE WHEN part % 5 = 0 THEN 'tombstone' ELSE 'active' END AS status
FROM candidates_v"""
VIEWS["matches_v"] = """
SELECT entry_index, target_entity AS id FROM entries_v WHERE target_entity IS NOT NULL
UNION ALL
SELECT e.entry_index, 'item:' || v.lowered FROM entries_v e JOIN (SELECT DISTINCT source_id, original_id, lowered FROM candidates_v) v
  ON e.by_source AND e.target_source = v.source_id AND e.target_original = v.original_id"""
VIEWS["counted_v"] = """
SELECT e.*, coalesce(m.n, 0) AS matches, m.id FROM entries_v e LEFT JOIN
  (SELECT entry_index, count(*) AS n, min(id) AS id FROM matches_v GROUP BY entry_index) m USING (entry_index)"""


def _matches(spark, sf):
    return routing.entry_matches(registry_entries(spark, sf), merged(spark, sf).select("kind", "id"), variants(spark, sf))


@query("J14_matching_entities", "SELECT entry_index, id FROM matches_v")
def matching_entities(spark, sf):
    return _matches(spark, sf)


SQL_ISSUES = """
SELECT * FROM (SELECT CASE WHEN matches > 1 THEN 'route_registry_target_ambiguous' WHEN status = 'tombstone' AND matches = 1 THEN 'route_registry_tombstone_active'
  WHEN status = 'active' AND matches = 0 THEN 'route_registry_target_missing'
  WHEN status = 'active' AND entry_index > first_entry THEN 'route_registry_entity_duplicate' END AS code, entry_index, CASE WHEN matches = 1 THEN c.id END AS entity_id
FROM counted_v c LEFT JOIN (SELECT id, min(entry_index) AS first_entry FROM counted_v WHERE status = 'active' AND matches = 1 GROUP BY id) f ON f.id = c.id)
WHERE code IS NOT NULL"""


@query("Q07_registry_issues", SQL_ISSUES)
def registry_issues(spark, sf):
    return routing.registry_issues(registry_entries(spark, sf), _matches(spark, sf), merged(spark, sf))


@query("U06_unregistered", """
SELECT 'item:' || lowered AS id FROM winners_v WHERE 'item:' || lowered NOT IN (SELECT id FROM counted_v WHERE status = 'active' AND matches = 1)""")
def unregistered(spark, sf):
    return routing.unregistered(merged(spark, sf), registry_entries(spark, sf), _matches(spark, sf)).select("id")


def previous_entries(spark, sf):
    """The predecessor: the same owners with one more alias, and without the multiples of seven."""
    now = registry_entries(spark, sf).filter("entry_index % 7 <> 0")
    more = F.when(F.expr("entry_index % 2 = 0"), F.array_append("aliases", F.lit("lost"))).otherwise(F.col("aliases"))
    return now.withColumn("aliases", more)


@query("U04_alias_retention", """
SELECT entry_index, CASE WHEN entry_index % 2 = 0 THEN 'lost' ELSE '' END AS missing FROM entries_v WHERE entry_index % 7 <> 0""")
def alias_retention(spark, sf):
    before = previous_entries(spark, sf).select("entry_index", F.col("aliases").alias("before"))
    now = registry_entries(spark, sf).select("entry_index", F.col("aliases").alias("now"))
    return before.join(now, "entry_index", "left").select(
        "entry_index", F.array_join(routing.missing_aliases(F.col("before"), F.col("now")), ",").alias("missing"))


VIEWS["targets_v"] = """
SELECT *, coalesce(target_entity, '') || '|' || CASE WHEN by_source THEN target_source || '|' || target_original ELSE '' END AS target FROM entries_v"""


@query("U05_orphan_tombstones", """
SELECT entry_index FROM targets_v WHERE status = 'tombstone' AND target NOT IN (SELECT target FROM targets_v WHERE entry_index % 7 <> 0)""")
def orphan_tombstones(spark, sf):
    return routing.uninherited_tombstones(registry_entries(spark, sf), previous_entries(spark, sf)).select("entry_index")


# ---- registries of all versions ----------------------------------------------------------

VIEWS["headers_v"] = """
SELECT 'd' || o_custkey AS dataset_id, 'v' || o_orderkey AS dataset_version, o_orderkey AS sequence, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS schema_version,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 OR (before IS NULL AND o_orderkey % 5 <> 0) THEN 'root' ELSE 'inherited' END AS lineage_type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'elsewhere' ELSE 'v' || coalesce(before, 0) END AS lineage_version, CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE 's' || coalesce(before, 0) END AS lineage_sha256,
  's' || o_orderkey AS sha256
FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)"""
VIEWS["linked_v"] = """
SELECT h.*, lag(dataset_version) OVER w AS p_version, lag(schema_version) OVER w AS p_schema, lag(sha256) OVER w AS p_sha FROM headers_v h WINDOW w AS (PARTITION BY dataset_id ORDER BY sequence)"""
VIEWS["header_codes_v"] = """
SELECT dataset_id, dataset_version, unnest(CASE
  WHEN schema_version = 1 THEN CASE WHEN p_version IS NULL THEN ['route_registry_publication_schema'] ELSE ['route_registry_publication_schema', 'route_registry_predecessor_unexpected'] END
  WHEN lineage_type IS NULL THEN ['route_registry_publication_schema']
  WHEN lineage_type = 'root' THEN CASE WHEN p_version IS NULL THEN [] ELSE ['route_registry_predecessor_unexpected'] END
  WHEN p_version IS NULL THEN ['route_registry_predecessor_missing']
  WHEN p_schema = 2 AND p_version = lineage_version AND p_sha = lineage_sha256 THEN [] ELSE ['route_registry_predecessor_mismatch'] END) AS code FROM linked_v"""
VIEWS["logged_v"] = """
SELECT 'd' || o_custkey AS dataset_id, 'v' || o_orderkey AS dataset_version, o_orderkey AS sequence, t AS entry_index, 'item' AS kind, 'source-id' AS target_type, 's' || t % 2 AS target_source, 'o' || t AS target_original,
  CASE WHEN (o_orderkey + t) % 23 = 0 THEN 'tombstone' ELSE 'active' END AS status, 'slug-' || CASE WHEN (o_orderkey + t) % 29 = 0 THEN t + 1 ELSE t END AS canonical_slug, (o_orderkey + t) % 3 = 0 AS renamed
FROM orders CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE (o_orderkey + t) % 31 <> 0"""


def headers(spark, sf):
    return source(spark, sf, "headers_v").withColumn("sequence", F.col("sequence").cast("bigint"))


def logged_entries(spark, sf):
    rows = source(spark, sf, "logged_v")
    aliases = F.when(F.col("renamed"), F.array(F.concat(F.lit("old-"), "target_original"), F.lit("shared"))).otherwise(F.array(F.concat(F.lit("old-"), "target_original")))
    return rows.withColumn("target_entity", F.lit(None).cast("string")).withColumn("aliases", aliases).drop("renamed", "sequence")


@query("Q07_header_issues", "SELECT * FROM header_codes_v")
def registry_headers(spark, sf):
    """Every version of every registry against its predecessor, as for publication."""
    return route_log.header_issues(route_log.with_predecessors(headers(spark, sf)), publication=True).select("dataset_id", "dataset_version", "code")


@query("Q07_lineage_issues", """
SELECT dataset_id, dataset_version, code, CAST(entry_index AS BIGINT) AS entry_index, message FROM (
  WITH fine AS (
    SELECT dataset_id, dataset_version, CASE WHEN lineage_type <> 'root' THEN p_version END AS p_version FROM linked_v l
    WHERE schema_version = 2 AND NOT EXISTS (SELECT 1 FROM header_codes_v c WHERE c.dataset_id = l.dataset_id AND c.dataset_version = l.dataset_version)),
  before AS (
    SELECT f.dataset_id, f.dataset_version, e.target_source, e.target_original, e.canonical_slug, e.renamed FROM fine f JOIN logged_v e ON e.dataset_id = f.dataset_id AND e.dataset_version = f.p_version)
  SELECT b.dataset_id, b.dataset_version, 'route_registry_inheritance_stale' AS code, n.entry_index,
    'Inherited route owner ["item","source-id","' || b.target_source || '","' || b.target_original || '"] must retain its canonical slug and every historical alias.' AS message
  FROM before b LEFT JOIN logged_v n USING (dataset_id, dataset_version, target_source, target_original) WHERE n.canonical_slug IS NULL OR n.canonical_slug <> b.canonical_slug OR (b.renamed AND NOT n.renamed)
  UNION ALL
  SELECT n.dataset_id, n.dataset_version, 'route_registry_tombstone_uninherited', n.entry_index, 'Tombstone ["item","source-id","' || n.target_source || '","' || n.target_original || '"] does not reserve a route from the predecessor registry.'
  FROM logged_v n JOIN fine f USING (dataset_id, dataset_version) LEFT JOIN before b USING (dataset_id, dataset_version, target_source, target_original) WHERE n.status = 'tombstone' AND b.canonical_slug IS NULL)""", big="entry_index")
def registry_lineage(spark, sf):
    linked = route_log.with_predecessors(headers(spark, sf))
    return route_log.lineage_issues(logged_entries(spark, sf), linked).withColumn("entry_index", F.col("entry_index").cast("bigint"))


query("Q07_scope_issues", "SELECT dataset_id, dataset_version, 'Route registry does not match dataset ' || dataset_id || '@v' || newest || '.' AS message FROM headers_v JOIN (SELECT 'd' || o_custkey AS dataset_id, max(o_orderkey) AS newest FROM orders GROUP BY 1) USING (dataset_id) WHERE dataset_version <> 'v' || newest")(
    lambda spark, sf: route_log.scope_issues(headers(spark, sf), headers(spark, sf).groupBy("dataset_id").agg(F.max_by("dataset_version", "sequence").alias("active_version"))).select(
        "dataset_id", "dataset_version", "message"))
query("Q07_version_as_of", """SELECT a.dataset_id, a.sequence, arg_max(h.dataset_version, h.sequence) AS version
  FROM (SELECT 'd' || o_custkey AS dataset_id, o_orderkey + o_custkey % 900 - 300 AS sequence FROM orders) a LEFT JOIN headers_v h ON h.dataset_id = a.dataset_id AND h.sequence <= a.sequence GROUP BY ALL, a.sequence""".replace("GROUP BY ALL, a.sequence", "GROUP BY a.dataset_id, a.sequence"))(
    lambda spark, sf: route_log.version_as_of(table(spark, sf, "orders").selectExpr("concat('d', o_custkey) AS dataset_id", "o_orderkey + o_custkey % 900 - 300 AS sequence").distinct(), headers(spark, sf)))
query("Q07_reassigned_routes", """
WITH places AS (SELECT dataset_id, dataset_version, sequence, row_number() OVER (PARTITION BY dataset_id ORDER BY sequence) AS place FROM headers_v),
held AS (SELECT DISTINCT l.dataset_id, p.place, p.sequence, route, target_original AS target FROM (
    SELECT *, unnest(CASE WHEN renamed THEN [canonical_slug, 'old-' || target_original, 'shared'] ELSE [canonical_slug, 'old-' || target_original] END) AS route FROM logged_v) l JOIN places p USING (dataset_id, dataset_version)),
runs AS (SELECT dataset_id, route, target, min(sequence) AS since FROM (SELECT *, place - row_number() OVER (PARTITION BY dataset_id, route, target ORDER BY place) AS run FROM held) GROUP BY dataset_id, route, target, run),
moved AS (SELECT *, lag(target) OVER (PARTITION BY dataset_id, route ORDER BY since, 's' || CAST(substr(target, 2) AS INT) % 2, target) AS previous FROM runs)
SELECT dataset_id, route, previous AS previous_target, target, since FROM moved WHERE previous <> target""")(
    lambda spark, sf: route_log.reassigned_routes(route_log.route_intervals(logged_entries(spark, sf), headers(spark, sf))).select(
        "dataset_id", "route", *[F.regexp_extract(c, '"(o[0-9]+)"', 1).alias(c) for c in ("previous_target", "target")], "since"))


def clean_entries(spark, sf):
    """An entry for every merged name, by entity id, and a tombstone for as many names that are gone."""
    m = merged(spark, sf)
    own = m.select(F.col("part").alias("entry_index"), "kind", F.lit("entity-id").alias("target_type"), F.col("id").alias("target_entity"), F.lit("active").alias("status"), F.lit("pin-").alias("head"))
    gone = m.select((-F.col("part") - 1).alias("entry_index"), "kind", F.lit("entity-id").alias("target_type"), F.concat("id", F.lit(" gone")).alias("target_entity"), F.lit("tombstone").alias("status"), F.lit("was-").alias("head"))
    return own.unionByName(gone).select(
        "entry_index", "kind", "target_type", "target_entity", F.lit(None).cast("string").alias("target_source"), F.lit(None).cast("string").alias("target_original"), "status",
        F.concat("head", F.abs("entry_index").cast("string")).alias("canonical_slug"), F.array(F.concat("head", F.lit("old-"), F.abs("entry_index").cast("string"))).alias("aliases"))


@query("Q07_apply_registry", """SELECT 'route_registry_applied' AS code, 'Pinned route pin-' || part || ' for ' || name || '.' AS message, 'item:' || lowered AS entity_id, '["pin-old-' || part || '"]' AS aliases FROM winners_v
  UNION ALL SELECT 'tombstone', 'was-' || CASE old WHEN 1 THEN 'old-' ELSE '' END || (part + 1), NULL, NULL FROM winners_v, (SELECT unnest([0, 1]) AS old)""")
def apply_registry(spark, sf):
    """A registry in order: every name is pinned, and the routes of what is gone stay reserved."""
    entities, entries = merged(spark, sf), clean_entries(spark, sf)
    matches = routing.entry_matches(entries, entities.select("kind", "id"), variants(spark, sf))
    issues = routing.registry_issues(entries, matches, entities, publication=True)
    told = route_log.registry_drafts(issues, routing.apply_registry(entries, matches, issues), entries, entities, "routes.json")
    return told.select("code", "message", "entity_id", F.col("details")["aliases"].alias("aliases")).unionByName(routing.tombstone_routes(entries).select(
        F.lit("tombstone").alias("code"), F.col("slug").alias("message"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("aliases")))


query("Q07_registry_drafts", f"""SELECT code, 'Route registry ' || CASE code WHEN 'route_registry_tombstone_active' THEN 'tombstone ' ELSE 'entry ' END || entry_index || CASE code WHEN 'route_registry_target_ambiguous' THEN ' resolves to multiple active item records.'
    WHEN 'route_registry_tombstone_active' THEN ' resolves to an active item; mark it active to reclaim its routes.' ELSE ' does not resolve to an active item.' END AS message FROM ({SQL_ISSUES}) WHERE code <> 'route_registry_entity_duplicate'
  UNION ALL SELECT code, 'Multiple route registry entries resolve to ' || name || '.' FROM ({SQL_ISSUES}) i JOIN winners_v w ON i.entity_id = 'item:' || w.lowered WHERE code = 'route_registry_entity_duplicate'""")(
    lambda spark, sf: route_log.registry_drafts(
        routing.registry_issues(registry_entries(spark, sf), _matches(spark, sf), merged(spark, sf)), routing.apply_registry(
            registry_entries(spark, sf), _matches(spark, sf), routing.registry_issues(registry_entries(spark, sf), _matches(spark, sf), merged(spark, sf))),
        registry_entries(spark, sf), merged(spark, sf), "routes.json").select("code", "message"))


# ---- diagnostics ---------------------------------------------------------------------

def drafts(spark, sf):
    raw = source(spark, sf, "drafts_v")
    return raw.select(
        "severity", "code", "message", "source_id", "file", "line", F.col("col").alias("column"), "entity_id",
        F.create_map(F.lit("level"), F.col("detail").cast("string"), F.lit("code"), merge.json_text(F.col("code"))).alias("details"))


VIEWS["signed_v"] = """
SELECT *, substr(sha256('{' || chr(10) || '  "code": "' || code || '",' || chr(10) || '  "details": {' || chr(10) || '    "code": "' || code || '",' || chr(10)
  || '    "level": ' || detail || chr(10) || '  },' || chr(10) || '  "entityId": "' || entity_id || '",' || chr(10) || '  "message": "' || message || '",' || chr(10)
  || '  "severity": "' || severity || '",' || chr(10) || '  "source": {' || chr(10) || '    "column": 1,' || chr(10) || '    "file": "' || file || '",' || chr(10)
  || '    "line": ' || line || ',' || chr(10) || '    "sourceId": "' || source_id || '"' || chr(10) || '  }' || chr(10) || '}' || chr(10)), 1, 12) AS signature
FROM drafts_v"""
VIEWS["diagnostics_v"] = """
SELECT code || ':' || signature || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, severity, code, message, entity_id
FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY line) AS n FROM signed_v)"""


def final_diagnostics(spark, sf):
    return diagnostics.finalize(drafts(spark, sf))


@query("W06_diagnostic_identity", "SELECT id, severity, message, entity_id FROM diagnostics_v")
def diagnostic_identity(spark, sf):
    return final_diagnostics(spark, sf).select("id", "severity", "message", "entity_id")


@query("A01_count_diagnostics", """
SELECT count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error FROM drafts_v""")
def count_diagnostics(spark, sf):
    return diagnostics.count_by_severity(drafts(spark, sf))


@query("A02_group_by_code", "SELECT severity, code, count(*) AS occurrences FROM drafts_v GROUP BY severity, code")
def group_by_code(spark, sf):
    return diagnostics.group_by_code(drafts(spark, sf))


@query("J39_attach_diagnostics", """
SELECT entity_id, id AS diagnostic_id, count(*) OVER (PARTITION BY entity_id) AS diagnostic_count FROM diagnostics_v""")
def attach_diagnostics(spark, sf):
    return diagnostics.attach_ids(final_diagnostics(spark, sf))


@query("P10_entity_diagnostics", "SELECT id, entity_id FROM diagnostics_v WHERE entity_id IN (SELECT 'monster:' || CASE WHEN c_nationkey < 10 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END FROM customer)")
def entity_diagnostics(spark, sf):
    monsters = table(spark, sf, "customer").select(F.expr("concat('monster:', CASE WHEN c_nationkey < 10 THEN cast(c_custkey AS string) ELSE c_name END)").alias("id"))
    return diagnostics.of_entity(final_diagnostics(spark, sf), monsters).select("id", "entity_id")


@query("Q04_diagnostic_counts", """
SELECT severity, CAST(n + 1 AS BIGINT) AS stored, n AS found FROM (SELECT severity, count(*) AS n FROM drafts_v GROUP BY severity) WHERE severity = 'warning'""")
def diagnostic_counts(spark, sf):
    final = final_diagnostics(spark, sf)
    stored = drafts(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "n", F.col("n") + F.when(F.col("severity") == "warning", 1).otherwise(0))
    return quality.count_mismatches(final, stored)


@query("Q10_publication_gate", "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'error') = 0 AS publishable FROM drafts_v")
def publication_gate(spark, sf):
    return diagnostics.may_publish(drafts(spark, sf))


# ---- patches -------------------------------------------------------------------------

def patch_entities(spark, sf):
    m = merged(spark, sf)
    text = merge.json_text
    return m.select(
        "kind", "canonical_key", "id", "name", "source_id",
        F.create_map(F.lit("description"), text(F.col("description")), F.lit("category"), text(F.col("category")),
                     F.lit("price"), F.col("price").cast("string"), F.lit("quality"), F.col("quality").cast("string")).alias("fields"))


def patch_operations(spark, sf):
    """One operation or two per merged name, each guard broken by some of them."""
    m = merged(spark, sf)
    rows = m.select(
        F.expr("CASE part % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END").alias("patch_id"), "part", "kind",
        F.expr("CASE WHEN part % 11 = 1 THEN canonical_key || ' lost' ELSE canonical_key END").alias("canonical_key"),
        F.expr("CASE WHEN part % 13 = 1 THEN 'elsewhere' ELSE source_id END").alias("patch_source"),
        F.expr("CASE WHEN part % 17 = 1 THEN 'slug' ELSE 'price' END").alias("field"),
        F.expr("CASE WHEN part % 19 = 1 THEN '\"x\"' WHEN part % 23 = 1 THEN '1' ELSE cast(price AS string) END").alias("expected"),
        F.expr("CASE WHEN part % 29 = 1 THEN cast(price AS string) ELSE cast(price + 5 AS string) END").alias("value"),
        F.explode(F.expr("CASE WHEN part % 31 = 1 THEN array(0, 1) ELSE array(0) END")).alias("again"))
    return rows.withColumn("op_index", F.col("part") * 2 + F.col("again")).drop("again")


VIEWS["operations_v"] = """
SELECT *, CASE WHEN again = 1 THEN 'patch_duplicate_operation' WHEN part % 11 = 1 THEN 'patch_target_missing' WHEN part % 13 = 1 THEN 'patch_source_mismatch'
  WHEN part % 17 = 1 THEN 'patch_field_unsupported' WHEN part % 19 = 1 THEN 'patch_value_invalid'
  WHEN (CASE WHEN part % 23 = 1 THEN 1 ELSE price END) = (CASE WHEN part % 29 = 1 THEN price ELSE price + 5 END) THEN 'patch_noop'
  WHEN part % 23 = 1 AND price <> 1 THEN 'patch_precondition_failed' END AS issue
FROM (SELECT *, CASE part % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS patch_id, part * 2 + again AS op_index
  FROM winners_v, (SELECT range AS again FROM range(2)) WHERE again = 0 OR part % 31 = 1)"""


@query("Q09_patch_guards", "SELECT patch_id, op_index, issue FROM operations_v WHERE issue IS NOT NULL")
def patch_guards(spark, sf):
    checked = patching.checked_operations(patch_operations(spark, sf), patch_entities(spark, sf))
    return checked.filter("issue is not null").select("patch_id", "op_index", "issue")


@query("J13_patch_targets", "SELECT patch_id, op_index, CASE WHEN issue IS NULL OR issue NOT IN ('patch_duplicate_operation', 'patch_target_missing') THEN 'item:' || lowered END AS entity_id FROM operations_v")
def patch_targets(spark, sf):
    return patching.checked_operations(patch_operations(spark, sf), patch_entities(spark, sf)).select("patch_id", "op_index", "entity_id")


@query("W07_repeated_operations", "SELECT patch_id, op_index FROM operations_v WHERE again = 1")
def repeated_operations(spark, sf):
    return patching.repeated_operations(patch_operations(spark, sf)).select("patch_id", "op_index")


@query("U01_apply_patches", """
SELECT 'item:' || w.lowered AS id, CASE WHEN w.part % 3 = 0 AND w.part % 2 = 0 THEN w.price + 5 ELSE w.price END AS price, w.part % 3 = 0 AND w.part % 2 = 0 AS patched FROM winners_v w""")
def apply_patches(spark, sf):
    """One clean patch is applied, the faulty ones change nothing."""
    m = merged(spark, sf).select("part", "kind", "canonical_key", "source_id", "price")
    clean = m.filter("part % 3 = 0 and part % 2 = 0").select(
        F.lit("clean").alias("patch_id"), F.col("part").alias("op_index"), "kind", "canonical_key", F.col("source_id").alias("patch_source"),
        F.lit("price").alias("field"), F.col("price").cast("string").alias("expected"), (F.col("price") + 5).cast("string").alias("value"))
    faulty = patch_operations(spark, sf).filter("part % 3 = 1").select(clean.columns)
    after, _ = patching.apply_patches(patch_entities(spark, sf), faulty.unionByName(clean), ["second", "clean"])
    return after.select("id", F.col("fields")["price"].cast("bigint").alias("price"), (F.size("applied_patches") > 0).alias("patched"))


def chained_operations(spark, sf):
    """Five patches per merged name, one after the other on its price; each expects what an earlier one may have written."""
    m = merged(spark, sf).select("part", "kind", "canonical_key", "source_id", "price")
    steps = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    worth = lambda e: F.expr(f"cast(price + 5 * (({e}) % 3) AS string)")
    return steps.select(
        F.expr("concat('patch-', part, '-', k)").alias("patch_id"), F.expr("k * 100000000 + part").alias("rank"), F.lit(0).cast("bigint").alias("op_index"), "kind", "canonical_key",
        F.lit("price").alias("field"), worth("part * (k + 1) + k").alias("expected"), worth("part + 2 * k * k + k").alias("value"), F.col("source_id").alias("patch_source"))


VIEWS["settled_v"] = """
SELECT *, list_reduce([CAST(0 AS BIGINT), 0, 1, 2, 3, 4], lambda held, k: CASE WHEN held = (part * (k + 1) + k) % 3 AND (part * (k + 1) + k) % 3 <> (part + 2 * k * k + k) % 3 THEN (part + 2 * k * k + k) % 3 ELSE held END) AS steps
FROM winners_v"""


@query("U01_patch_chains", "SELECT 'item:' || lowered AS id, price + 5 * steps AS price FROM settled_v", big="price")
def patch_chains(spark, sf):
    """As many patches as five times the merged names, settled together."""
    operations = chained_operations(spark, sf)
    after, _ = patching.apply_patches(patch_entities(spark, sf), operations.drop("rank"), operations.select("patch_id", "rank"))
    return after.select("id", F.col("fields")["price"].cast("bigint").alias("price"))


@query("Q11_patch_notices", """
SELECT CASE WHEN issue IS NULL THEN 'patch_applied' ELSE issue END AS code, count(*) AS n FROM (
  SELECT CASE WHEN again = 1 THEN 'patch_duplicate_operation' WHEN part % 11 = 1 THEN 'patch_target_missing' WHEN part % 13 = 1 THEN 'patch_source_mismatch'
    WHEN part % 17 = 1 THEN 'patch_field_unsupported' WHEN part % 19 = 1 THEN 'patch_value_invalid'
    WHEN (CASE WHEN part % 23 = 1 THEN 1 ELSE price END) = (CASE WHEN part % 29 = 1 THEN price ELSE price + 5 END) THEN 'patch_noop'
    WHEN part % 23 = 1 AND price <> 1 THEN 'patch_precondition_failed' END AS issue, part, again, max(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY part) AS doubled
  FROM winners_v, (SELECT range AS again FROM range(2)) WHERE again = 0 OR part % 31 = 1)
WHERE issue IS NOT NULL OR doubled = 0 GROUP BY ALL""")
def patch_notices(spark, sf):
    """A patch per merged name: its issues, or a notice that it was applied."""
    operations = patch_operations(spark, sf).withColumn("patch_id", F.expr("concat('patch-', part)"))
    order = operations.select("patch_id", F.col("part").alias("rank")).distinct()
    _, judged = patching.apply_patches(patch_entities(spark, sf), operations.drop("part"), order)
    files = order.select("patch_id", F.concat("patch_id", F.lit(".json")).alias("file"))
    told = patching.patch_drafts(judged, files.join(operations.select("patch_id", F.col("patch_source").alias("source_id")).distinct(), "patch_id"))
    return told.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("Q08_patch_scope", """
SELECT part, CASE WHEN part % 4 = 0 OR part % 5 = 0 OR s.version IS NULL OR part % 6 = 0 THEN 'patch_scope_mismatch' END AS issue
FROM winners_v w LEFT JOIN sources_v s ON s.id = w.source_id""")
def patch_scope(spark, sf):
    sources = source(spark, sf, "sources_v")
    patches = merged(spark, sf).select(
        "part", "source_id", F.expr("CASE WHEN part % 4 = 0 THEN 'other' ELSE 'parts' END").alias("dataset_id"),
        F.expr("CASE WHEN part % 5 = 0 THEN '2' ELSE '1' END").alias("dataset_version"),
        F.expr("CASE WHEN part % 6 = 0 THEN 'old' ELSE 'v' || length(source_id) END").alias("source_version"))
    return patching.patch_scope_issues(patches, sources, "parts", "1").select("part", "issue")


# ---- reports on decisions ---------------------------------------------------------------

def _decided(spark, sf):
    steps = merge.override_steps(merge.history(candidates(spark, sf), FIELDS))
    counts = steps.groupBy("kind", F.concat_ws(":", "kind", "canonical_key").alias("id")).agg(F.count(F.lit(1)).alias("overrides"))
    patched = merged(spark, sf).filter("part % 3 = 0").select("kind", "id", F.lit(1).alias("patches"))
    return merged(spark, sf), counts, patched


DECISIONS = "SELECT 'item:' || lowered AS id, source_id, position - 1 AS overrides, CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS patches FROM winners_v"


@query("R03_source_decisions", f"SELECT id, source_id, overrides, CAST(patches AS BIGINT) AS patches FROM ({DECISIONS}) WHERE overrides > 0 OR patches > 0")
def source_decisions(spark, sf):
    return reports.source_decisions(*_decided(spark, sf)).select("id", "source_id", "overrides", "patches")


@query("P09_decided_only", f"SELECT id FROM ({DECISIONS}) WHERE overrides > 0 OR patches > 0")
def decided_only(spark, sf):
    return reports.source_decisions(*_decided(spark, sf)).select("id")


@query("Q11_duplicate_notices", """
SELECT source_id || ' overrides ' || p_source || ' for item ' || name || '.' AS message, 'item:' || lowered AS entity_id, line FROM ordered_v WHERE position > 1""")
def duplicate_notices(spark, sf):
    return merge.duplicate_notices(merge.history(candidates(spark, sf), FIELDS)).select("message", "entity_id", "line")


@query("N02_base_entity", f"SELECT part, 'item:' || lowered AS id, lowered AS canonical_key, {SQL_SLUGGED} AS slug, source_id, line FROM candidates_v")
def base_entity(spark, sf):
    c = candidates(spark, sf)
    return c.select("part", entity_id("item", F.col("name")).alias("id"), "canonical_key", slugify(F.col("name")).alias("slug"), "source_id", "line")
