"""S, K and the remaining rows: parsing, declared inputs, inventories, assets, publication."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..normalize import catalogue as whole
from ..operators import publish, quality, route_log, search
from ..session import durable, use_checkpoint_dir
from ..sources import assets, files as stored, inputs, trees, xml_records
from . import views  # noqa: F401
from .registry import VIEWS, query, source, table
from .search_queries import documents, entities

# ---- XML -------------------------------------------------------------------------------

XML = """CASE p_partkey % 8 WHEN 0 THEN '<db><item name="a"></db>' WHEN 1 THEN '<!DOCTYPE x><db/>' WHEN 2 THEN '  '
  ELSE '<db>' || chr(10) || '  <!-- <item name="no"/> -->' || chr(10) || '  <item name="' || p_name || '" level="' || cast(p_size as string) || '"><price amount="3"/></item><item/>' || chr(10) || '</db>' END"""


def item_files(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("source_id"), F.concat(F.lit("itemDB-"), "p_partkey", F.lit(".xml")).alias("file"), F.lit("items").alias("kind"),
        F.col("p_size").cast("int").alias("precedence"), F.expr(XML).alias("content"))


@query("S03_parse_xml", """SELECT 'itemDB-' || p_partkey || '.xml' AS file, CASE p_partkey % 8 WHEN 0 THEN 'invalid_xml' WHEN 1 THEN 'disallowed_doctype' WHEN 2 THEN 'invalid_xml' END AS problem,
  CASE WHEN p_partkey % 8 > 2 THEN 2 ELSE 0 END AS records FROM part""", big="records")
def parse_xml(spark, sf):
    parsed = xml_records.parse_xml(item_files(spark, sf))
    return parsed.groupBy("file").agg(F.max("problem").alias("problem"), F.count("record").alias("records"))


query("Q11_xml_rejections", "SELECT CASE p_partkey % 8 WHEN 1 THEN 'disallowed_doctype' ELSE 'invalid_xml' END AS code, count(*) AS n FROM part WHERE p_partkey % 8 <= 2 GROUP BY 1")(
    lambda spark, sf: xml_records.problems(xml_records.parse_xml(item_files(spark, sf))).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
query("S06_positions", "SELECT 'itemDB-' || p_partkey || '.xml' AS file, 3 AS line, CAST(3 + k * (length('<item name=\"\" level=\"\"><price amount=\"3\"/></item>') + length(p_name) + length(CAST(p_size AS VARCHAR))) AS INT) AS \"column\" FROM part, (SELECT CAST(range AS INT) AS k FROM range(2)) WHERE p_partkey % 8 > 2")(
    lambda spark, sf: xml_records.records(xml_records.parse_xml(item_files(spark, sf)), "item").select("file", "line", "column"))

NEST = """'<monDB><monster name="m' || cast(c_custkey as string) || '"><group><monster><monster name="leaf"/></monster></group></monster><monster name="solo"/></monDB>'"""


def monster_files(spark, sf):
    return table(spark, sf, "customer").select(
        F.lit("base").alias("source_id"), F.concat(F.lit("monDB-"), "c_custkey", F.lit(".xml")).alias("file"), F.lit("monsters").alias("kind"),
        F.lit(0).alias("precedence"), F.expr(NEST).alias("content"))


query("S04_collect_elements", "SELECT 'monDB-' || c_custkey || '.xml' AS file, 4 AS found FROM customer", big="found")(
    lambda spark, sf: xml_records.records(xml_records.parse_xml(monster_files(spark, sf)), "monster").groupBy("file").agg(F.count(F.lit(1)).alias("found")))
query("S05_nested_parents", """SELECT 'monDB-' || c_custkey || '.xml' AS file, n AS name, CASE WHEN n = 'leaf' OR n IS NULL THEN 'm' || c_custkey END AS parent_name
FROM customer, (SELECT unnest(['', 'leaf', 'solo', NULL]) AS k), LATERAL (SELECT CASE WHEN k = '' THEN 'm' || c_custkey ELSE k END AS n)""")(
    lambda spark, sf: xml_records.records(xml_records.parse_xml(monster_files(spark, sf)), "monster").select(
        "file", F.col("record.attrs")["name"].alias("name"), "parent_name"))

# Trees of one to thirteen levels below each record; every level has a leaf beside the next one.
DEEP = """'<db><item name="i' || p_partkey || '">' || repeat('<group><leaf/>', cast(p_partkey % 13 + 1 as int)) || repeat('</group>', cast(p_partkey % 13 + 1 as int)) || '</item></db>'"""


def deep_nodes(spark, sf):
    """Parts are a few megabytes, one task of a scan; the texts made of them are dealt out to as many tasks as a shuffle has."""
    parts = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return trees.parse_nodes(parts.select(
        F.col("p_brand").alias("source_id"), F.concat(F.lit("deep-"), "p_partkey", F.lit(".xml")).alias("file"), F.lit("items").alias("kind"), F.lit(0).alias("precedence"), F.expr(DEEP).alias("content")))


@query("S03_whole_trees", """SELECT 'deep-' || p_partkey || '.xml' AS file, 2 + 2 * levels AS nodes, 2 + levels AS deepest, 'i' || p_partkey AS name, 2 * levels AS inside, 'db/item' || repeat('/group', CAST(levels AS INT)) || '/leaf' AS longest
  FROM (SELECT p_partkey, p_partkey % 13 + 1 AS levels FROM part)""", big="nodes deepest inside")
def whole_trees(spark, sf):
    """Per file: all nodes, the depth of the deepest, the descendants of its record, and the longest path."""
    nodes = deep_nodes(spark, sf)
    counted = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("bigint").alias("deepest"))
    inside = trees.descendants(nodes, trees.record_elements(nodes)).groupBy("file").agg(F.count(F.lit(1)).alias("inside"), F.max("node").alias("node"))
    named = trees.record_elements(nodes).select("file", F.col("attrs")["name"].alias("name"))
    last = nodes.join(inside.select("file", "node").hint("merge"), ["file", "node"])
    paths = trees.path(nodes, last).select("file", F.col("path").alias("longest"))
    return counted.join(inside.drop("node").hint("merge"), "file").join(named.hint("merge"), "file").join(paths.hint("merge"), "file")


query("S04_collect_at_any_depth", "SELECT 'deep-' || p_partkey || '.xml' AS file, k AS levels, 2 + k AS depth FROM part, LATERAL (SELECT unnest(range(1, p_partkey % 13 + 2)) AS k)", big="levels depth")(
    lambda spark, sf: trees.descendants(trees.elements(deep_nodes(spark, sf), "leaf"), trees.elements(deep_nodes(spark, sf), "item")).select(
        "file", (F.col("levels") - 1).cast("bigint").alias("levels"), F.col("depth").cast("bigint").alias("depth")))
query("S05_nearest_holder", """SELECT 'monDB-' || c_custkey || '.xml' AS file, n AS name, CASE WHEN n = 'leaf' OR n IS NULL THEN 'm' || c_custkey END AS parent_name
FROM customer, (SELECT unnest(['', 'leaf', 'solo', NULL]) AS k), LATERAL (SELECT CASE WHEN k = '' THEN 'm' || c_custkey ELSE k END AS n)""")(
    lambda spark, sf: (lambda m: trees.with_nearest(m, m, "name", "parent_name").select("file", F.col("attrs")["name"].alias("name"), "parent_name"))(
        trees.elements(trees.parse_nodes(monster_files(spark, sf)), "monster")))
query("N40_unknown_at_any_depth", "SELECT 'deep-' || p_partkey || '.xml' AS file, k AS parent, 'leaf' AS tag, 1 AS times FROM part, LATERAL (SELECT unnest(range(1, p_partkey % 13 + 2)) * 2 AS k)", big="parent times")(
    lambda spark, sf: trees.unknown_elements(deep_nodes(spark, sf), {"group": ["group"], "db": ["item"]}).select("file", "parent", "tag", "times"))
query("A21_xml_audit", "SELECT 'items' AS kind, count(*) FILTER (p_partkey % 8 > 2) AS valid, count(*) FILTER (p_partkey % 8 <= 2) AS invalid, 2 * count(*) FILTER (p_partkey % 8 > 2) AS records FROM part", big="records")(
    lambda spark, sf: inputs.xml_audit(xml_records.parse_xml(item_files(spark, sf))))
query("A21_file_audit", "SELECT '.xml' AS extension, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT '[none]', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents WHERE doc_id % 3 <> 0")(
    lambda spark, sf: inputs.file_audit(table(spark, sf, "documents").select(
        F.concat(F.lit("game/doc"), "doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN '.XML' ELSE '' END")).alias("path"), F.col("n_chars").alias("bytes"))))
query("S03_pages_doctype", "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<!doctype')")(
    lambda spark, sf: xml_records.problems(xml_records.parse_xml(table(spark, sf, "pages").select(
        F.lit("web").alias("source_id"), F.col("page_id").cast("string").alias("file"), F.lit("a").alias("kind"), F.lit(0).alias("precedence"),
        F.col("html").alias("content")))).filter("code = 'disallowed_doctype'").select(F.col("file").cast("bigint").alias("page_id")))
WRAPPER = """CASE c_custkey % 3 WHEN 0 THEN '<sprite><frame> a' || cast(c_custkey as string) || '.png </frame><frame>b.png</frame></sprite>' WHEN 1 THEN '<sprite><frame/></sprite>' ELSE '<sprite>' END"""
query("N47_first_frame", """SELECT 'art/m' || c_custkey || '.xml' AS file, CASE WHEN c_custkey % 3 = 0 THEN 'art/a' || c_custkey || '.png' END AS frame,
  CASE c_custkey % 3 WHEN 1 THEN 'The monster sprite wrapper has no nonblank <frame> path.' WHEN 2 THEN 'The monster sprite wrapper is not valid XML.' END AS message FROM customer""")(
    lambda spark, sf: xml_records.first_frame(xml_records.parse_xml(table(spark, sf, "customer").select(
        F.lit("base").alias("source_id"), F.concat(F.lit("art/m"), "c_custkey", F.lit(".xml")).alias("file"), F.lit("frame").alias("kind"), F.lit(0).alias("precedence"),
        F.expr(WRAPPER).alias("content")))).select("file", "frame", "message"))


@query("N01_parse_database", """SELECT 'recipe' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'template', count(*) FROM region UNION ALL SELECT 'stat', count(*) FROM nation UNION ALL SELECT 'item', count(*) FROM part
  UNION ALL SELECT unnest(['skill', 'ability']), count(*) FROM supplier UNION ALL SELECT 'monster', 2 * count(*) FROM customer UNION ALL SELECT 'encrustment', count(*) FROM documents UNION ALL SELECT 'instability', count(*) FROM documents
  UNION ALL SELECT 'spell', count(*) FROM pages""")
def parse_database(spark, sf):
    """All eight kinds of database files through one entry point."""
    def files(name, kind, content):
        return table(spark, sf, name).select(F.lit("base").alias("source_id"), F.lit(kind + ".xml").alias("file"), F.lit(kind).alias("kind"), F.lit(0).alias("precedence"),
                                             F.expr(content).alias("content"))

    declared = [
        files("orders", "recipes", """'<db><craft name="r' || o_orderkey || '"/></db>'"""), files("region", "templates", """'<db><template name="' || r_name || '"/></db>'"""),
        files("nation", "stats", """'<db><stat name="' || n_name || '"/></db>'"""), files("part", "items", """'<db><item name="' || p_name || '"/></db>'"""),
        files("supplier", "skills", """'<db><skill name="' || s_name || '"/><ability name="' || s_name || '" skill="' || s_name || '"/></db>'"""),
        files("customer", "monsters", """'<db><monster name="' || c_name || '"><monster name="sub"/></monster></db>'"""),
        files("documents", "encrustments", """'<db><encrust name="e' || doc_id || '"/><unstableEffect name="u" spell="s"/></db>'"""),
        files("pages", "spells", """'<db><spell name="s' || page_id || '"/></db>'""")]
    parsed = durable(xml_records.parse_xml(reduce(lambda a, b: a.unionByName(b), declared)))
    counted = [entities.select(F.lit(name).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")) for name, entities in whole.parse_all(parsed).items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


# ---- declared inputs ----------------------------------------------------------------------

MANIFEST = """'{"schemaVersion": ' || cast(1 + s_suppkey % 2 as string) || ', "datasetId": "d' || cast(s_suppkey as string) || '", "datasetVersion": "v9", "sources": [{"id": "base", "label": "Base", "kind": "base", "version": "3", "precedence": 0, "root": "r", "files": [{"kind": "items", "path": "a.xml"}, {"kind": "items", "path": "../b.xml"}]}, {"id": "' || CASE WHEN s_suppkey % 5 = 0 THEN 'base' ELSE 'mod' END || '", "label": "Mod", "kind": "mod", "version": "4", "precedence": 5, "root": "m", "files": [{"kind": "spells", "path": "s.xml"}], "presentedAssets": [{"id": "logo", "path": "l.png"}]}], "patches": [{"order": 1, "path": "p.json"}]' || CASE WHEN s_suppkey % 7 = 0 THEN ', "previousRouteRegistry": "x.json"' ELSE '' END || '}'"""


def manifest_texts(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("manifest"), F.expr(MANIFEST).alias("json"))


query("S01_load_manifest", """SELECT s_suppkey AS manifest, 'd' || s_suppkey AS dataset_id, CASE WHEN s_suppkey % 2 = 0 THEN 'unversioned' ELSE 'v9' END AS dataset_version, s.id, CASE WHEN s_suppkey % 2 = 0 THEN 'unversioned' ELSE s.v END AS version
FROM supplier, LATERAL (SELECT unnest(['base', CASE WHEN s_suppkey % 5 = 0 THEN 'base' ELSE 'mod' END]) AS id, unnest(['3', '4']) AS v) s""")(
    lambda spark, sf: (lambda m: inputs.declared_sources(m).join(m.select("manifest", "dataset_id", "dataset_version"), "manifest").select(
        "manifest", "dataset_id", "dataset_version", "id", "version"))(inputs.load_manifests(manifest_texts(spark, sf))))
query("S01_declared_files", """SELECT s_suppkey AS manifest, f.path, f.ok AS valid FROM supplier, (SELECT unnest(['r/a.xml', 'r/../b.xml', 'm/s.xml']) AS path, unnest([TRUE, FALSE, TRUE]) AS ok) f""")(
    lambda spark, sf: inputs.declared_files(inputs.load_manifests(manifest_texts(spark, sf))).select("manifest", "path", "valid"))
query("S02_migrate_manifest", "SELECT s_suppkey AS manifest, 'now' AS dataset_version, 's2,s2' AS versions FROM supplier WHERE s_suppkey % 2 = 0")(
    lambda spark, sf: inputs.migrate_manifests(manifest_texts(spark, sf).filter("manifest % 2 = 0"), "now", "s2").select(
        "manifest", "dataset_version", F.array_join(F.transform("sources", lambda s: s["version"]), ",").alias("versions")))
query("Q06_manifest_issues", """SELECT 'source declared twice' AS rule, s_suppkey || ':base' AS subject FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'previous registry without a current one', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 7 = 0""")(
    lambda spark, sf: (lambda m: quality.manifest_issues(
        inputs.declared_sources(m), inputs.declared_assets(m), m.select("manifest", F.explode("patches").alias("p")).select("manifest", "p.path"), m).select(
        "rule", F.col("subject").cast("string").alias("subject")))(inputs.load_manifests(manifest_texts(spark, sf))))
PATCH = """'{"schemaVersion": 1, "id": "' || CASE WHEN p_partkey % 4 = 0 THEN 'Bad ' ELSE 'fix-' END || cast(p_partkey as string) || '", "reason": "r", "appliesTo": {"datasetId": "d", "datasetVersion": "1", "sourceId": "' || p_brand || '", "sourceVersion": "2"}, "operations": [{"entityKind": "item", "canonicalKey": "' || CASE WHEN p_partkey % 3 = 0 THEN 'Red ' ELSE '' END || p_name || '", "field": "price", "expectedValue": ' || cast(p_size as string) || ', "value": null}, {"entityKind": "item", "canonicalKey": "k", "field": "description", "expectedValue": "a", "value": ["x"]}]}'"""


def patch_texts(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), F.expr(PATCH).alias("json"))


@query("K01_file_checksums", """SELECT 'nation' AS table_name, 1 AS files, count(*) AS rows, CAST(sum(strlen(json) + 1) AS BIGINT) AS bytes, sha256(string_agg(json || chr(10), '' ORDER BY n_nationkey)) AS sha256
  FROM (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation)
  UNION ALL SELECT 'part', NULL, count(*), CAST(sum(strlen('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}') + 1) AS BIGINT), NULL FROM part""", big="files")
def file_checksums(spark, sf):
    """Files of a published set: one whose bytes SQL can name, and the sums over many."""
    nations = table(spark, sf, "nation").repartition(1).sortWithinPartitions("n_nationkey")
    folder = _scratch(spark)
    publish.serialize_outputs({"nation": nations, "part": table(spark, sf, "part").select("p_partkey", "p_name").repartition(4)}, folder, file_bytes=1 << 14)
    files = publish.published_files(spark, folder, ["nation", "part"])
    return files.groupBy("table_name").agg(
        F.when(F.col("table_name") == "nation", F.count(F.lit(1))).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.max(F.when(F.col("table_name") == "nation", F.col("sha256"))).alias("sha256"))


@query("K06_read_outputs", "SELECT p_partkey, p_name FROM part")
def read_outputs(spark, sf):
    folder = _scratch(spark)
    publish.serialize_outputs({"part": table(spark, sf, "part").select("p_partkey", "p_name")}, folder)
    return publish.read_outputs(spark, folder, {"part": "p_partkey long, p_name string"})["part"]


def stored_inputs(spark, sf):
    """The files of two sources, written from suppliers and customers, and what is declared about them."""
    folder = _scratch(spark)
    for name, text, rows in (("base", "s_name", table(spark, sf, "supplier").select("s_name", F.concat(F.lit("s"), "s_suppkey").alias("file"))),
                             ("mod", "n_name", table(spark, sf, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("file")))):
        rows.select(F.col(text).alias("value"), "file").repartition(2).write.partitionBy("file").text(f"{folder}/{name}")
    roots = [f"{folder}/base", f"{folder}/mod"]
    found = stored.found_files(spark, roots)
    named = found.withColumn("path", F.regexp_extract("path", "^file=([^/]+)/part", 1)).filter("path <> ''")
    return roots, named.withColumn("file", F.concat_ws("/", F.element_at(F.split("root", "/"), -1), "path"))


query("S10_stored_files", "SELECT 'base/s' || s_suppkey AS file, sha256(s_name || chr(10)) AS sha256, CAST(strlen(s_name) + 1 AS BIGINT) AS bytes FROM supplier UNION ALL SELECT 'mod/n' || n_nationkey, sha256(n_name || chr(10)), CAST(strlen(n_name) + 1 AS BIGINT) FROM nation")(
    lambda spark, sf: stored.snapshot(stored_inputs(spark, sf)[1]))
query("S10_changed_inputs", """SELECT 'base/s' || s_suppkey AS file, CASE s_suppkey % 4 WHEN 1 THEN 'changed' ELSE 'new' END AS problem FROM supplier WHERE s_suppkey % 4 IN (1, 2)
  UNION ALL SELECT 'base/gone-' || s_suppkey, 'missing' FROM supplier""")(lambda spark, sf: _changed(spark, sf))


def _changed(spark, sf):
    now = stored.snapshot(stored_inputs(spark, sf)[1])
    n = F.regexp_extract("file", "base/s([0-9]+)$", 1)
    number = F.when(n != "", n.cast("bigint"))
    kept = now.filter(~F.coalesce(number % 4 == 2, F.lit(False))).withColumn("sha256", F.when(F.coalesce(number % 4 == 1, F.lit(False)), F.lit("0")).otherwise(F.col("sha256")))
    gone = table(spark, sf, "supplier").select(F.concat(F.lit("base/gone-"), "s_suppkey").alias("file"), F.lit("1").alias("sha256"), F.lit(1).cast("bigint").alias("bytes"))
    return stored.compared(now, kept.unionByName(gone))


query("U08_missing_files", "SELECT 'N' || n_nationkey AS path FROM nation WHERE FALSE UNION ALL SELECT 'base/lost-' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")(
    lambda spark, sf: stored.missing_files(table(spark, sf, "supplier").select(F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('base/lost-', s_suppkey) ELSE concat('BASE\\\\S', s_suppkey) END").alias("path")),
                                           stored_inputs(spark, sf)[1].select(F.col("file").alias("path"))))


query("S08_read_patches", """SELECT 'p' || p_partkey AS file, o.i AS op_index, p_brand AS patch_source, o.field, CASE WHEN o.i = 0 THEN CAST(p_size AS VARCHAR) ELSE '"a"' END AS expected, CASE WHEN o.i = 0 THEN 'null' ELSE '["x"]' END AS value
FROM part, (SELECT unnest([0, 1]) AS i, unnest(['price', 'description']) AS field) o""")(
    lambda spark, sf: inputs.read_patches(patch_texts(spark, sf)).select("file", "op_index", "patch_source", "field", "expected", "value"))
query("S08_patch_file_issues", """SELECT 'Bad ' || p_partkey AS patch_id, 'id is not kebab case' AS rule, i AS op_index FROM part, (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 4 = 0
UNION ALL SELECT 'fix-' || p_partkey, 'key is not canonical', 0 FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0""")(
    lambda spark, sf: inputs.patch_file_issues(inputs.read_patches(patch_texts(spark, sf))).select("patch_id", "rule", "op_index"))
REGISTRY = """'{"schemaVersion": 1, "datasetId": "d", "datasetVersion": "1", "entries": [{"entityKind": "item", "target": {"type": "source-id", "sourceId": "' || p_brand || '", "originalId": "P' || cast(p_partkey as string) || '"}, "canonicalSlug": "' || CASE WHEN p_partkey % 5 = 0 THEN 'Not Normal' ELSE 'slug' END || '", "aliases": ["old", "' || CASE WHEN p_partkey % 3 = 0 THEN 'slug' ELSE 'older' END || '"]}]}'"""


def registry_texts(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("r"), "p_partkey").alias("file"), F.expr(REGISTRY).alias("json"))


query("S09_read_registries", """SELECT 'r' || p_partkey AS file, p_brand AS target_source, 'P' || p_partkey AS target_original, 'active' AS status, 'old,' || CASE WHEN p_partkey % 3 = 0 THEN 'slug' ELSE 'older' END AS aliases FROM part""")(
    lambda spark, sf: inputs.read_registries(registry_texts(spark, sf)).select("file", "target_source", "target_original", "status", F.array_join("aliases", ",").alias("aliases")))
query("S09_registry_file_issues", "SELECT 'slug is its own alias' AS rule, count(*) AS n FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT 'route not normal', count(*) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'route owned twice', 3 + CASE WHEN count(*) FILTER (p_partkey % 3 <> 0) > 1 THEN 1 ELSE 0 END FROM part", big="n")(
    lambda spark, sf: _registry_rules(spark, sf))


def _registry_rules(spark, sf):
    from ..operators.routing import registry_file_issues

    return registry_file_issues(inputs.read_registries(registry_texts(spark, sf))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def registered(spark, sf):
    """Texts as inputs: four display paths per hundred stand for two files."""
    return table(spark, sf, "documents").select(
        F.expr("CASE WHEN doc_id % 50 < 2 THEN 'shared-' || (doc_id div 2) ELSE 'doc-' || doc_id END").alias("file"), F.concat(F.lit("/in/"), "doc_id").alias("path"), F.col("text").alias("content"))


query("S10_inventory", "SELECT '/in/' || doc_id AS path, sha256(text) AS sha256, CAST(strlen(text) AS INT) AS bytes FROM documents")(
    lambda spark, sf: inputs.inventory(registered(spark, sf)).select("path", "sha256", "bytes"))
query("S10_path_conflicts", "SELECT file, count(*) AS paths FROM (SELECT CASE WHEN doc_id % 50 < 2 THEN 'shared-' || doc_id // 2 ELSE 'doc-' || doc_id END AS file FROM documents) GROUP BY file HAVING count(*) > 1")(
    lambda spark, sf: inputs.inventory_conflicts(registered(spark, sf)))
DAMAGE_CASE = "CASE l_linenumber % 4 WHEN 0 THEN 'crushing' WHEN 1 THEN 'toxic' WHEN 2 THEN 'voltaic' ELSE 'none' END"
query("S11_reference_stats", f"SELECT name, count(*) AS uses FROM (SELECT CASE {DAMAGE_CASE} WHEN 'crushing' THEN 'Crushing Damage' WHEN 'toxic' THEN 'Toxic Damage' WHEN 'voltaic' THEN 'Voltaic Damage' END AS name FROM lineitem) WHERE name IS NOT NULL GROUP BY name")(
    lambda spark, sf: table(spark, sf, "lineitem").select(F.lit("damage").alias("modifier_kind"), F.expr(DAMAGE_CASE).alias("source_key")).join(
        inputs.reference_stats(spark), ["modifier_kind", "source_key"]).groupBy("name").agg(F.count(F.lit(1)).alias("uses")))
query("S12_load_order", "SELECT manifest, path FROM (SELECT s_suppkey AS manifest, unnest(['r/../b.xml', 'r/a.xml', 'm/s.xml']) AS path FROM supplier)")(
    lambda spark, sf: inputs.load_order(inputs.declared_files(inputs.load_manifests(manifest_texts(spark, sf)))).select("manifest", "path"))
PATCHED = """'{"schemaVersion": 2, "datasetId": "d", "datasetVersion": "1", "sources": [], "patches": [{"order": ' || cast(3 - p_partkey % 3 as string) || ', "path": "b.json"}, {"order": 2, "path": "z' || cast(p_partkey as string) || '.json"}, {"order": 2, "path": "c.json"}]' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ', "routeRegistry": "routes.json"' END || '}'"""


def patched_manifests(spark, sf):
    return inputs.load_manifests(table(spark, sf, "part").select(F.col("p_partkey").alias("manifest"), F.expr(PATCHED).alias("json")))


query("S12_patch_order", """SELECT p_partkey AS manifest, CASE p_partkey % 3 WHEN 0 THEN 'c.json,z' || p_partkey || '.json,b.json' WHEN 1 THEN 'b.json,c.json,z' || p_partkey || '.json' ELSE 'b.json,c.json,z' || p_partkey || '.json' END AS paths FROM part""")(
    lambda spark, sf: inputs.declared_patches(patched_manifests(spark, sf)).groupBy("manifest").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda p: p["path"]), ",").alias("paths")))
query("S12_repeated_patches", "SELECT p_partkey AS manifest, 'b' AS patch_id, CAST(2 AS BIGINT) AS files FROM part WHERE p_partkey % 5 = 0")(
    lambda spark, sf: inputs.repeated_patch_ids(inputs.declared_patches(patched_manifests(spark, sf)).withColumn(
        "patch_id", F.expr("CASE WHEN manifest % 5 = 0 AND path = 'c.json' THEN 'b' ELSE replace(path, '.json', '') END"))))
query("Q11_publication_missing", "SELECT 'm' || p_partkey AS file, 'route_registry_publication_missing' AS code, 'Publication mode requires a schema-2 route registry with explicit lineage.' AS message FROM part WHERE p_partkey % 4 = 0")(
    lambda spark, sf: route_log.publication_missing(patched_manifests(spark, sf).select(F.concat(F.lit("m"), "manifest").alias("manifest_file"), F.col("registry").alias("registry_file"))).select("file", "code", "message"))
query("S13_active_sources", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 0 OR CASE WHEN c_custkey % 3 = 0 THEN c_nationkey > 12 ELSE c_custkey % 2 = 0 END")(
    lambda spark, sf: inputs.active_sources(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 10 = 0").alias("required"), F.expr("c_custkey % 2 = 0").alias("active_by_default")),
        table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.expr("c_nationkey > 12").alias("active"))).select("id"))


# ---- assets ----------------------------------------------------------------------------------

def asset_sources(spark, sf):
    return table(spark, sf, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("id"), F.col("n_nationkey").cast("int").alias("rank"), F.expr("CASE WHEN n_nationkey = 3 THEN 'reference' ELSE 'mod' END").alias("kind"))


def asset_files(spark, sf):
    """Which source has which path: that of each part's size and nation number."""
    return table(spark, sf, "part").select(F.concat(F.lit("src"), F.expr("p_partkey % 25")).alias("source_id"), F.concat(F.lit("art/"), "p_size", F.lit(".png")).alias("path")).distinct()


def icon_owners(spark, sf):
    return table(spark, sf, "orders").select(
        F.lit("item-icon").alias("kind"), F.col("o_orderkey").alias("id"), F.concat(F.lit("src"), F.expr("o_orderkey % 25")).alias("source_id"),
        F.concat(F.lit("art/"), F.expr("o_custkey % 60"), F.lit(".png")).alias("icon_path"))


VIEWS["asset_files_v"] = "SELECT DISTINCT p_partkey % 25 AS rank, 'art/' || CAST(p_size AS STRING) || '.png' AS path FROM part WHERE p_partkey % 25 <> 3"
VIEWS["icons_v"] = """
SELECT o.o_orderkey AS id, o.o_orderkey % 25 AS own, max(f.rank) AS best, 'art/' || CAST(o.o_custkey % 60 AS STRING) || '.png' AS path FROM orders o
LEFT JOIN asset_files_v f ON f.path = 'art/' || CAST(o.o_custkey % 60 AS STRING) || '.png' AND f.rank <= o.o_orderkey % 25 GROUP BY ALL"""


def icons(spark, sf):
    sources = asset_sources(spark, sf)
    return assets.icon_files(icon_owners(spark, sf), assets.files_by_path(asset_files(spark, sf), sources), sources)


query("J20_icon_fallback", "SELECT id, 'src' || coalesce(best, own) AS file_source, best IS NOT NULL AS found FROM icons_v")(
    lambda spark, sf: icons(spark, sf).select("id", "file_source", "found"))


def monster_assets(spark, sf):
    sources = asset_sources(spark, sf)
    by_path = assets.files_by_path(asset_files(spark, sf).unionByName(table(spark, sf, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("source_id"), F.explode(F.array(F.lit("m.xml"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'f.png' END"), F.expr(
            "CASE WHEN n_nationkey >= 10 THEN 'p.pal' END"))).alias("path")).filter("path is not null")), sources)
    monsters = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'm.xml' ELSE 'gone.png' END").alias("icon_path"), F.concat(F.lit("src"), "c_nationkey").alias("icon_source"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'p.pal' END").alias("palette_name"), F.concat(F.lit("src"), "c_nationkey").alias("palette_source"))
    frames = table(spark, sf, "nation").select(
        F.concat(F.lit("src"), "n_nationkey").alias("file_source"), F.lit("m.xml").alias("icon_path"), F.expr("CASE WHEN n_nationkey % 5 <> 0 THEN 'f.png' END").alias("frame"),
        F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 'no frame' END").alias("message"))
    return assets.monster_files(monsters, by_path, frames, sources)


VIEWS["monster_assets_v"] = """
SELECT id, even, CASE WHEN near % 5 = 0 THEN 'invalid_monster_sprite_wrapper' WHEN even AND near % 2 = 1 THEN 'missing_monster_sprite_frame' WHEN even AND pal AND nation < 10 THEN 'missing_monster_palette' END AS issue
FROM (SELECT c_custkey AS id, c_custkey % 2 = 0 AS even, c_custkey % 4 = 0 AS pal, c_nationkey AS nation, CASE WHEN c_nationkey = 3 THEN 2 ELSE c_nationkey END AS near FROM customer)"""
query("J21_monster_assets", "SELECT id, CASE WHEN even THEN issue END AS issue, even AND (issue IS NULL OR issue = 'missing_monster_palette') AS usable FROM monster_assets_v")(
    lambda spark, sf: monster_assets(spark, sf).select(
        "id", "issue", (F.col("found") & (F.col("issue").isNull() | (F.col("issue") == "missing_monster_palette"))).alias("usable")))
query("J22_ui_overlay", "SELECT 'ui' || p_partkey % 300 AS id, arg_max('Brand' || p_partkey, p_partkey) AS source_id FROM part GROUP BY 1")(
    lambda spark, sf: assets.ui_overlay(table(spark, sf, "part").select(
        F.concat(F.lit("ui"), F.expr("p_partkey % 300")).alias("id"), F.concat(F.lit("Brand"), "p_partkey").alias("source_id"), F.col("p_partkey").alias("rank"),
        F.lit("p.png").alias("path"))).select("id", "source_id"))


def asset_list(spark, sf):
    kinds = [k.withColumn("id", F.col("id").cast("string")) for k in (icons(spark, sf).withColumnRenamed("icon_path", "path"), monster_assets(spark, sf))]
    return assets.asset_inputs(*kinds)


query("U09_asset_inputs", "SELECT kind, count(*) AS n FROM (SELECT 'item-icon' AS kind FROM orders UNION ALL SELECT 'monster-icon' FROM customer) GROUP BY kind")(
    lambda spark, sf: asset_list(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def outcomes(spark, sf):
    head = F.expr("CASE WHEN cast(id AS bigint) % 7 = 0 THEN '00' ELSE '89504E470D0A1A0A' END")
    return icons(spark, sf).select("kind", F.col("id").cast("string").alias("entity_id"), assets.outcome(
        F.col("kind"), F.col("icon_path"), F.col("found"), F.lit(None).cast("string"), head, F.expr("cast(id AS bigint) % 11 <> 0")).alias("code"))


OUTCOME = "CASE WHEN best IS NULL THEN 'missing_presented_asset' WHEN id % 7 = 0 THEN 'invalid_presented_asset_signature' WHEN id % 11 = 0 THEN 'invalid_presented_asset_png' END"
query("A22_asset_outcomes", f"SELECT {OUTCOME} AS code, count(*) AS n FROM icons_v GROUP BY 1")(
    lambda spark, sf: outcomes(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
query("Q12_outcome_issues", "SELECT CAST(id AS VARCHAR) AS entity_id, 'missing' AS problem FROM icons_v WHERE id % 13 = 0 UNION ALL SELECT CAST(id AS VARCHAR), 'repeated' FROM icons_v WHERE id % 13 = 1")(
    lambda spark, sf: (lambda o: quality.outcome_issues(o, o.filter("cast(entity_id AS bigint) % 13 <> 0").unionByName(o.filter("cast(entity_id AS bigint) % 13 = 1"))).select(
        "entity_id", "problem"))(outcomes(spark, sf)))


# ---- publication --------------------------------------------------------------------------------

def content_records(spark, sf):
    return table(spark, sf, "documents").select(F.lit("item-icon").alias("kind"), F.col("doc_id").cast("string").alias("entity_id"), F.col("text").alias("content"))


query("K08_asset_catalogue", "SELECT 'files/' || sha256(text) || '.png' AS file, count(*) AS uses FROM documents GROUP BY text")(
    lambda spark, sf: assets.asset_catalogue(content_records(spark, sf))[1].select("file", "uses"))


@query("K09_verify_catalogue", "SELECT CAST(doc_id AS VARCHAR) AS entity_id, 'file missing' AS problem FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 17 = 0)")
def verify_catalogue(spark, sf):
    """A catalogue whose files of every seventeenth text are gone."""
    records, files = assets.asset_catalogue(content_records(spark, sf))
    lost = records.filter("cast(entity_id AS bigint) % 17 = 0").select("file")
    return assets.verify_catalogue(records, files.join(lost, "file", "left_anti")).select("entity_id", "problem")


query("K03_stable_json", """SELECT p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' AS json FROM part""")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", publish.stable_json(["p_size", "p_name", "p_brand"]).alias("json")))
query("K04_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", publish.digest(F.col("text")).alias("sha256")))
query("K05_determinism", "SELECT 0 AS differing_rows, count(*) AS compared FROM documents_v", big="differing_rows")(
    lambda spark, sf: _twice(spark, sf))


def _twice(spark, sf):
    """The derivation from rows dealt and ordered in another way, compared row by row both ways."""
    other = entities(spark, sf).repartition(5, "name").sortWithinPartitions(F.desc("id"))
    first, second = [d.drop("aliases", "stat_keys") for d in (documents(spark, sf), search.build_documents(other))]
    differing = publish.same_rows(first, second).agg(F.count(F.lit(1)).alias("differing_rows"))
    compared = first.agg(F.count(F.lit(1)).alias("compared"))
    return differing.unionByName(compared, allowMissingColumns=True).agg(
        F.max("differing_rows").alias("differing_rows"), F.max("compared").alias("compared"))


query("K07_search_is_derived", "SELECT CASE WHEN k = 0 THEN 'left' ELSE 'right' END AS side, id FROM documents_v, (SELECT unnest([0, 1]) AS k) WHERE kind = 'spell'")(
    lambda spark, sf: (lambda d: publish.same_rows(d.withColumn("summary", F.when(F.col("kind") == "spell", "stale").otherwise(F.col("summary"))), d).select("side", "id"))(
        documents(spark, sf).select("id", "kind", "summary")))


def _scratch(spark):
    """A new folder beside the cluster's checkpoints; the session removes it at its end."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/published-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@query("K02_write_outputs", "SELECT 'documents' AS table_name, count(*) AS rows FROM documents_v UNION ALL SELECT 'sources', count(*) FROM sources_v")
def write_outputs(spark, sf):
    docs = documents(spark, sf).drop("aliases", "stat_keys")
    manifest = publish.write_tables({"documents": docs, "sources": source(spark, sf, "sources_v")}, _scratch(spark))
    return manifest.select("table_name", "rows")


@query("K06_read_verified", "SELECT id, kind, name FROM documents_v")
def read_verified(spark, sf):
    folder = _scratch(spark)
    publish.write_tables({"documents": documents(spark, sf).drop("aliases", "stat_keys")}, folder)
    return publish.read_verified(spark, folder)["documents"].select("id", "kind", "name")


query("K01_table_digest", """SELECT count(*) AS rows, CAST(sum(strlen(json) + 1) AS BIGINT) AS bytes, CAST(sum(CAST(CAST('0x' || substr(sha256(json), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest
FROM (SELECT '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' AS json FROM part)""")(
    lambda spark, sf: publish.table_digest(table(spark, sf, "part").select("p_size", "p_name", "p_brand")))
