"""Links, dangling references, reviewed rules and backlinks over the test tables."""

from pyspark.sql import functions as F

from ..functions.keys import canonical_key
from ..operators import backlinks, linking
from . import views  # noqa: F401
from .registry import VIEWS, query, source, table

# Known items are the parts of at most size 25; the others dangle.
VIEWS["known_v"] = "SELECT p_partkey FROM part WHERE p_size <= 25"
VIEWS["edge_aliases_v"] = "SELECT 'part ' || CAST(p_partkey AS STRING) AS alias, 'item:' || CAST(p_partkey AS STRING) AS target_id FROM part WHERE p_size <= 25"


def known_items(spark, sf):
    return table(spark, sf, "part").filter("p_size <= 25").select(
        F.lit("item").alias("kind"), F.concat(F.lit("item:"), F.col("p_partkey")).alias("id"),
        F.concat(F.lit("part "), F.col("p_partkey")).alias("canonical_key"))


def item_aliases(spark, sf):
    items = known_items(spark, sf)
    variants = items.select("kind", "id", "canonical_key", F.lit(1).alias("position"), F.lit(None).cast("string").alias("original_id"),
                            F.upper("canonical_key").alias("original_name"))
    return linking.alias_table(items, variants)


def line_edges(spark, sf, path="inputs", kind="recipe", silent=False):
    lines = source(spark, sf, "lines_v")
    label = F.concat(F.lit("Part  "), F.col("part_no"))
    owners = lines.select(
        F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), F.col("recipe_no")).alias("id"), F.concat(F.lit("R"), F.col("recipe_no")).alias("name"),
        F.array(F.struct(label.alias("label"), canonical_key(label, ascii_text=True).alias("key"))).alias("refs"), "line_no", "amount", "supp_no", "part_no")
    return linking.reference_edges(owners, path, "refs", "item", silent)


SQL_LINKED = "SELECT '{kind}:' || l.recipe_no AS owner_id, 'Part  ' || l.part_no AS label, a.target_id FROM lines_v l LEFT JOIN edge_aliases_v a ON a.alias = 'part ' || l.part_no"


def _linked(kind, path):
    def run(spark, sf):
        return linking.link(line_edges(spark, sf, path, kind), item_aliases(spark, sf)).select("owner_id", "label", "target_id")

    return run


query("J03_link_recipes", SQL_LINKED.format(kind="recipe"))(_linked("recipe", "inputs"))


@query("J02_link_items", """
SELECT 'item:' || owner_no AS owner_id, modifier_kind AS path, coalesce(s.id, CAST(NULL AS VARCHAR)) AS target_id FROM
  (SELECT l_orderkey AS owner_no, l_suppkey % 30 AS stat_no, CASE l_linenumber % 3 WHEN 0 THEN 'stats' WHEN 1 THEN 'triggers' ELSE 'macguffins' END AS modifier_kind FROM lineitem) m
LEFT JOIN (SELECT 'stat' AS target_kind, 'nation_' || n_nationkey AS key, 'stat:' || n_nationkey AS id FROM nation
  UNION ALL SELECT 'spell', 'supplier ' || s_suppkey, 'spell:' || s_suppkey FROM supplier) s
ON s.target_kind = CASE m.modifier_kind WHEN 'stats' THEN 'stat' ELSE 'spell' END
  AND s.key = CASE m.modifier_kind WHEN 'stats' THEN 'nation_' ELSE 'supplier ' END || m.stat_no""")
def link_items(spark, sf):
    """Stats, triggers and macguffins of items, each to its own kind of target."""
    line = table(spark, sf, "lineitem")
    path = F.when(F.expr("l_linenumber % 3 = 0"), "stats").when(F.expr("l_linenumber % 3 = 1"), "triggers").otherwise("macguffins")
    kind = F.when(path == "stats", "stat").otherwise("spell")
    label = F.concat(F.when(path == "stats", F.lit("NATION_")).otherwise(F.lit("Supplier ")), F.expr("l_suppkey % 30"))
    edges = line.select(
        F.concat(F.lit("item:"), "l_orderkey").alias("owner_id"), path.alias("path"), kind.alias("target_kind"), label.alias("label"),
        canonical_key(label, ascii_text=True).alias("key"))
    stats = table(spark, sf, "nation").select(F.lit("stat").alias("kind"), F.concat(F.lit("stat:"), "n_nationkey").alias("id"),
                                             F.lower("n_name").alias("canonical_key"))
    spells = table(spark, sf, "supplier").select(F.lit("spell").alias("kind"), F.concat(F.lit("spell:"), "s_suppkey").alias("id"),
                                                F.concat(F.lit("supplier "), "s_suppkey").alias("canonical_key"))
    entities = stats.unionByName(spells)
    variants = entities.select("*", F.lit(1).alias("position"), F.lit(None).cast("string").alias("original_id"),
                               F.col("canonical_key").alias("original_name"))
    return linking.link(edges, linking.alias_table(entities, variants)).select("owner_id", "path", "target_id")


query("J37_craft_links", """
SELECT DISTINCT p.p_name AS name, CAST(l.l_orderkey AS BIGINT) AS craft_id, 'input' AS side FROM part p JOIN lineitem l ON l.l_linenumber % 2 = 0 AND l.l_partkey = p.p_partkey
UNION SELECT DISTINCT p.p_name, l.l_orderkey, 'output' FROM part p JOIN lineitem l ON l.l_linenumber % 2 = 1 AND l.l_partkey = p.p_partkey""")(
    lambda spark, sf: backlinks.craft_links_by_name(
        table(spark, sf, "part").select(F.col("p_name").alias("name")),
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_name").alias("item_name"), F.col("l_orderkey").alias("craft_id"),
            F.when(F.expr("l_linenumber % 2 = 0"), "input").otherwise("output").alias("side"))))


@query("J04_link_instability", """
SELECT 'Effect ' || l.l_linenumber AS name, l.l_orderkey AS owner, s.s_suppkey IS NOT NULL AS linked FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey * 2""")
def link_instability(spark, sf):
    line = table(spark, sf, "lineitem")
    label = F.concat(F.lit("Supplier "), F.col("l_suppkey") * 2)
    effects = line.select(
        F.concat(F.lit("Effect "), "l_linenumber").alias("name"), F.col("l_orderkey").alias("owner"), F.lit("spell").alias("target_kind"),
        canonical_key(label, ascii_text=True).alias("key"), label.alias("spell_name"), F.lit("base").alias("source_id"), F.lit("encrustDB.xml").alias("file"),
        F.col("l_orderkey").alias("line"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("original_id"), F.lit("x").alias("original_name"))
    spells = table(spark, sf, "supplier").select(F.lit("spell").alias("kind"), F.concat(F.lit("supplier "), "s_suppkey").alias("alias"),
                                                F.concat(F.lit("spell:"), "s_suppkey").alias("target_id"))
    linked = linking.link(effects, spells).withColumn("spell_key", F.col("key"))
    return linked.orderBy(*linking.instability_order()).select("name", "owner", F.col("target_id").isNotNull().alias("linked"))


@query("J05_link_abilities", """
SELECT l_orderkey AS ability, o.o_orderkey IS NOT NULL AS has_skill, s.s_suppkey AS spell FROM lineitem
LEFT JOIN orders o ON o.o_orderkey = l_partkey LEFT JOIN supplier s ON s.s_suppkey = l_suppkey + 50""")
def link_abilities(spark, sf):
    """Ability to skill and ability to spell are two kinds of edges in one join."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.monotonically_increasing_id().alias("row"))
    skill = F.concat(F.lit("skill "), "l_partkey")
    spell = F.concat(F.lit("spell "), F.col("l_suppkey") + 50)
    edges = line.select("l_orderkey", "row", F.explode(F.array(
        F.struct(F.lit("skill").alias("target_kind"), skill.alias("key")), F.struct(F.lit("spell").alias("target_kind"), spell.alias("key")))).alias("e"))
    edges = edges.select("l_orderkey", "row", "e.target_kind", "e.key")
    targets = table(spark, sf, "orders").select(F.lit("skill").alias("kind"), F.concat(F.lit("skill "), "o_orderkey").alias("alias"),
                                               F.col("o_orderkey").alias("target_id")).unionByName(
        table(spark, sf, "supplier").select(F.lit("spell").alias("kind"), F.concat(F.lit("spell "), "s_suppkey").alias("alias"),
                                            F.col("s_suppkey").alias("target_id")))
    linked = linking.link(edges, targets)
    return linked.groupBy("row", F.col("l_orderkey").alias("ability")).agg(
        F.max(F.when(F.col("target_kind") == "skill", F.col("target_id"))).isNotNull().alias("has_skill"),
        F.max(F.when(F.col("target_kind") == "spell", F.col("target_id"))).alias("spell")).drop("row")


VIEWS["rules_v"] = """
SELECT 'shop' AS dataset_id, '1' AS dataset_version, 'src' || CAST(p_partkey % 4 AS STRING) AS source_id, 'v1' AS source_version,
  'skill-loadout-item' AS relationship, 'Part  ' || CAST(p_partkey AS STRING) AS label, 'review:' || CAST(p_partkey AS STRING) AS review_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'item:' || CAST(p_partkey - 1 AS STRING) END AS corrected_id
FROM part WHERE p_size > 25 AND p_partkey % 3 <> 0"""


def _reviewed(spark, sf):
    linked = linking.link(line_edges(spark, sf, "loadouts", "skill"), item_aliases(spark, sf))
    part_no = F.regexp_extract("key", "([0-9]+)", 1).cast("bigint")
    scoped = linked.withColumn("dataset_id", F.lit("shop")).withColumn("dataset_version", F.lit("1")).withColumn(
        "source_id", F.concat(F.lit("src"), part_no % 4)).withColumn("source_version", F.lit("v1")).withColumn(
        "relationship", F.lit("skill-loadout-item"))
    owners = scoped.select("label", "owner_id").distinct()
    rules = source(spark, sf, "rules_v").join(owners, "label").select(*linking.REVIEW_KEYS, "review_id", "corrected_id")
    return linking.review(scoped, rules, known_items(spark, sf))


SQL_REVIEW = """
SELECT 'skill:' || l.recipe_no AS owner_id, 'Part  ' || l.part_no AS label, coalesce(a.target_id, CASE WHEN k.target_id IS NOT NULL THEN r.corrected_id END) AS target_id,
  CASE WHEN a.target_id IS NOT NULL OR k.target_id IS NOT NULL THEN 'resolved' WHEN r.corrected_id IS NULL AND r.review_id IS NOT NULL THEN 'source-only' ELSE 'unresolved' END AS status,
  CASE WHEN a.target_id IS NOT NULL THEN 'exact' WHEN k.target_id IS NOT NULL THEN 'reviewed-correction' END AS method,
  CASE WHEN a.target_id IS NULL AND (k.target_id IS NOT NULL OR r.corrected_id IS NULL) THEN r.review_id END AS review_id
FROM lines_v l LEFT JOIN edge_aliases_v a ON a.alias = 'part ' || l.part_no LEFT JOIN rules_v r ON r.label = 'Part  ' || l.part_no
LEFT JOIN edge_aliases_v k ON k.target_id = r.corrected_id"""
query("J11_reviewed_rules", SQL_REVIEW)(lambda spark, sf: _reviewed(spark, sf).select("owner_id", "label", "target_id", "status", "method", "review_id"))
query("J12_resolution_priority", f"SELECT status, method, count(*) AS edges FROM ({SQL_REVIEW}) GROUP BY status, method")(
    lambda spark, sf: _reviewed(spark, sf).groupBy("status", "method").agg(F.count(F.lit(1)).alias("edges")))
query("Q11_review_notices", f"""
SELECT owner_id, CASE method WHEN 'reviewed-correction' THEN 'reviewed_correction_reference' ELSE 'reviewed_source_only_reference' END AS code, review_id,
  CASE method WHEN 'reviewed-correction' THEN ' applies a reviewed item-label correction: ' || label || ' to the ' || target_id ELSE ' preserves a reviewed source-only item label: ' || label END AS said
FROM ({SQL_REVIEW}) WHERE review_id IS NOT NULL""")(
    lambda spark, sf: linking.review_drafts(_reviewed(spark, sf), known_items(spark, sf).select("id", F.concat(F.lit("the "), "id").alias("name")).distinct()).select(
        "owner_id", "code", F.regexp_extract(F.col("details")["reviewId"], '^"(.*)"$', 1).alias("review_id"), F.regexp_extract("message", "( (?:applies|preserves) .*)$", 1).alias("said")))
query("J06_link_skills", f"SELECT owner_id, label, status FROM ({SQL_REVIEW})")(
    lambda spark, sf: _reviewed(spark, sf).select("owner_id", "label", "status"))


@query("J09_selector_definitions", """
SELECT modifier_kind, source_key, min(id) AS stat_id FROM stats_v WHERE modifier_kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1""")
def selector_definitions(spark, sf):
    return linking.selector_table(source(spark, sf, "stats_v"))


@query("J10_link_modifiers", """
SELECT m.owner_id, m.position, s.stat_id FROM modifiers_v m LEFT JOIN (SELECT modifier_kind, source_key, min(id) AS stat_id FROM stats_v
  WHERE modifier_kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) s USING (modifier_kind, source_key)""")
def link_modifiers(spark, sf):
    return linking.link_modifiers(source(spark, sf, "modifiers_v"), linking.selector_table(source(spark, sf, "stats_v"))).select(
        "owner_id", "position", "stat_id")


@query("Q03_modifier_stats", """
SELECT owner_id, position, CASE WHEN s.id IS NULL THEN 'stat missing' ELSE 'selector differs' END AS problem FROM
  (SELECT *, 'stat:nation_' || CAST(position % 27 AS VARCHAR) AS stat_id FROM modifiers_v) m LEFT JOIN stats_v s ON s.id = m.stat_id
WHERE s.id IS NULL OR s.modifier_kind IS DISTINCT FROM m.modifier_kind OR s.source_key IS DISTINCT FROM m.source_key""")
def modifier_stats(spark, sf):
    from ..operators.quality import modifier_stat_issues

    uses = source(spark, sf, "modifiers_v").withColumn("stat_id", F.concat(F.lit("stat:nation_"), F.col("position") % 27))
    return modifier_stat_issues(uses, source(spark, sf, "stats_v")).select("owner_id", "position", "problem")


query("J40_dangling_report", "SELECT 'recipe:' || recipe_no AS owner_id, 'R' || recipe_no || ' references an unknown item: Part  ' || part_no AS message FROM lines_v WHERE part_no NOT IN (SELECT p_partkey FROM known_v)")(
    lambda spark, sf: linking.dangling(linking.link(line_edges(spark, sf), item_aliases(spark, sf))).select("owner_id", "message"))
query("U08_missing_files", "SELECT DISTINCT 'Part  ' || part_no AS label FROM lines_v WHERE part_no NOT IN (SELECT p_partkey FROM known_v)")(
    lambda spark, sf: linking.unmatched(line_edges(spark, sf), item_aliases(spark, sf)).select("label").distinct())


# ---- recipes and neighbours ----------------------------------------------------------

def recipe_sides(spark, sf):
    lines = source(spark, sf, "lines_v")
    inputs = lines.select(F.col("part_no").alias("item_id"), F.col("recipe_no").alias("recipe_id"), "amount")
    outputs = source(spark, sf, "recipes_v").select(F.col("output_no").alias("item_id"), F.col("recipe_no").alias("recipe_id"),
                                                    F.col("output_amount").cast("bigint").alias("amount"))
    return inputs, outputs


@query("J15_item_recipes", """
SELECT item_id, recipe_id, CAST(sum(used) AS BIGINT) AS input_amount, CAST(sum(makes) AS BIGINT) AS output_count FROM (
  SELECT part_no AS item_id, recipe_no AS recipe_id, amount AS used, 0 AS makes FROM lines_v
  UNION ALL SELECT output_no, recipe_no, 0, 1 FROM recipes_v) GROUP BY item_id, recipe_id""")
def item_recipes(spark, sf):
    return backlinks.recipe_relations(*recipe_sides(spark, sf)).select("item_id", "recipe_id", "input_amount", "output_count")


@query("J16_item_encrustments", "SELECT part_no AS item_id, recipe_no AS encrustment_id, CAST(sum(amount) AS BIGINT) AS input_amount FROM lines_v GROUP BY ALL HAVING sum(amount) > 0")
def item_encrustments(spark, sf):
    return backlinks.encrustment_relations(source(spark, sf, "lines_v").select(
        F.col("part_no").alias("item_id"), F.col("recipe_no").alias("encrustment_id"), "amount"))


@query("J17_item_drops", """
SELECT o_orderkey AS monster_id, 0 AS drop_index, o_custkey AS item_id, CAST(o_orderkey % 101 AS INT) AS chance FROM orders
UNION ALL SELECT o_orderkey, 1, o_orderkey % 50, 100 FROM orders WHERE o_orderkey % 2 = 0""")
def item_drops(spark, sf):
    drop = lambda item, chance: F.struct(item.cast("bigint").alias("item_id"), chance.cast("int").alias("chance"))
    monsters = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("m").alias("canonical_key"),
        F.array(drop(F.col("o_custkey"), F.expr("o_orderkey % 101")),
                drop(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END"), F.lit(100))).alias("drops"))
    return backlinks.drop_relations(monsters).select("monster_id", "drop_index", "item_id", "chance")


@query("J18_skill_abilities", """
SELECT l_suppkey AS skill_id, l_orderkey AS id, l_returnflag = 'A' AS start_skill, l_linenumber AS level FROM lineitem WHERE l_linestatus = 'F'""")
def skill_abilities(spark, sf):
    abilities = table(spark, sf, "lineitem").select(
        F.expr("CASE WHEN l_linestatus = 'F' THEN l_suppkey END").alias("skill_id"), F.col("l_orderkey").alias("id"),
        F.expr("l_returnflag = 'A'").alias("start_skill"), F.col("l_linenumber").alias("level"), F.col("l_shipdate").cast("string").alias("canonical_key"))
    ordered = backlinks.skill_abilities(abilities.withColumn("id", F.col("id").cast("string")))
    return ordered.select("skill_id", F.col("id").cast("bigint").alias("id"), "start_skill", "level")


def toolkits(spark, sf):
    """Items that carry order priorities as tool tags, in two spellings."""
    tag = "element_at(array('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'), cast(1 + (p_partkey + {0}) % 5 AS int))"
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lower("p_name").alias("canonical_key"), F.col("p_name").alias("name"),
        F.array(F.lit(None).cast("string"), F.lower(F.expr(tag.format(0))), F.expr(tag.format(1)), F.upper(F.expr(tag.format(0)))).alias("toolkit_tags"))


VIEWS["toolkits_v"] = """
SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_name) AS canonical_key, p_name AS name,
  ['1-urgent','2-high','3-medium','4-not specified','5-low'][CAST(1 + (p_partkey + k) % 5 AS INT)] AS tag_key, CAST(k + 1 AS INT) AS declaration_index
FROM part, (SELECT CAST(range AS INT) AS k FROM range(2))"""
query("J19_toolkit_tags", "SELECT id, tag_key, declaration_index FROM toolkits_v")(
    lambda spark, sf: backlinks.toolkit_tags(toolkits(spark, sf)).select("id", "tag_key", "declaration_index"))
query("J19_tool_users", """
SELECT tag_key, items * makers AS pairs, items FROM (SELECT tag_key, count(DISTINCT id) AS items FROM toolkits_v GROUP BY tag_key) JOIN (SELECT lower(tool) AS tag_key, count(*) AS makers FROM recipes_v GROUP BY 1) USING (tag_key)""")(
    lambda spark, sf: backlinks.tool_users(
        backlinks.toolkit_tags(toolkits(spark, sf)), source(spark, sf, "recipes_v").select("id", "tool")).select("tag_key", "pairs", "items"))
query("J19_makers_for_item", "SELECT id FROM recipes_v WHERE lower(tool) IN (SELECT tag_key FROM toolkits_v WHERE id = '8')")(
    lambda spark, sf: backlinks.makers_for_item(
        backlinks.toolkit_tags(toolkits(spark, sf)), source(spark, sf, "recipes_v").select("id", "tool"), "8").select("id"))
query("J19_items_for_tag", "SELECT id, declaration_index FROM toolkits_v WHERE tag_key = '2-high'")(
    lambda spark, sf: backlinks.items_for_tag(backlinks.toolkit_tags(toolkits(spark, sf)), "2-HIGH").select("id", "declaration_index"))


@query("J23_loadout_items", "SELECT l_suppkey AS item_id, l_orderkey AS skill_id, 1 AS loadout_index FROM lineitem WHERE l_linenumber <= 3")
def loadout_items(spark, sf):
    loadout = lambda item, status: F.struct(item.alias("item_id"), status.alias("status"))
    skills = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.lit("k").alias("canonical_key"),
        F.array(loadout(F.col("l_partkey"), F.lit("unresolved")), loadout(F.col("l_suppkey"), F.when(F.expr("l_linenumber <= 3"), "resolved").otherwise("source-only"))).alias("loadouts"))
    return backlinks.loadout_relations(skills).select("item_id", "skill_id", "loadout_index")


VIEWS["brew_v"] = """
SELECT o_orderkey AS recipe_no, o_custkey AS i1, o_custkey % 100 AS i2, o_orderkey % 70 AS u1, o_custkey AS u2, o_orderkey % 30 AS u3 FROM orders"""


@query("J41_used_to_craft", """
SELECT item_id, CAST(rank AS INT) AS rank, output_id FROM (
  SELECT item_id, output_id, row_number() OVER (PARTITION BY item_id ORDER BY k, r, n) AS rank FROM (
    SELECT item_id, output_id, k, r, n FROM (
      SELECT i.item_id, o.output_id, lpad(CAST(recipe_no AS VARCHAR), 12, '0') AS k, 'r' || recipe_no AS r, o.n,
        row_number() OVER (PARTITION BY i.item_id, o.output_id ORDER BY lpad(CAST(recipe_no AS VARCHAR), 12, '0'), o.n) AS first FROM
      (SELECT recipe_no, i1 AS item_id FROM brew_v UNION SELECT recipe_no, i2 FROM brew_v) i
      JOIN (SELECT recipe_no, 0 AS n, u1 AS output_id FROM brew_v UNION ALL SELECT recipe_no, 1, u2 FROM brew_v UNION ALL SELECT recipe_no, 2, u3 FROM brew_v) o
      USING (recipe_no) WHERE i.item_id <> o.output_id) WHERE first = 1)) WHERE rank <= 4""")
def used_to_craft(spark, sf):
    recipes = source(spark, sf, "brew_v").select(
        F.lpad(F.col("recipe_no").cast("string"), 12, "0").alias("canonical_key"), F.concat(F.lit("r"), "recipe_no").alias("id"),
        F.array("i1", "i2").alias("input_items"), F.array("u1", "u2", "u3").alias("output_items"))
    return backlinks.used_to_craft(recipes)


@query("J36_recipe_cards", """
SELECT l.recipe_no AS recipe_id, 'in' AS side, l.line_no AS position, coalesce(p.p_name, 'Part ' || l.part_no) AS item_name, l.amount,
  CASE WHEN s.kind = 'mod' THEN 'Mod' WHEN s.id IS NOT NULL THEN 'BPB' || substr(regexp_extract(s.id, '[0-9]+'), 1, 1) END AS marker
FROM lines_v l JOIN orders o ON o.o_orderkey = l.recipe_no LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON p.p_partkey = l.part_no
LEFT JOIN sources_v s ON s.id = 'Brand#' || (o.o_custkey % 30)""")
def recipe_cards(spark, sf):
    recipes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), F.expr("o_custkey % 30")).alias("source_id"))
    references = source(spark, sf, "lines_v").select(
        F.col("recipe_no").alias("recipe_id"), F.lit("in").alias("side"), F.col("line_no").alias("position"), F.col("part_no").alias("item_id"),
        F.concat(F.lit("Part "), "part_no").alias("item_name"), "amount")
    items = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"))
    return backlinks.recipe_cards(recipes, references, items, source(spark, sf, "sources_v")).select(
        "recipe_id", "side", "position", "item_name", "amount", "marker")


# ---- spells ------------------------------------------------------------------------------

def spells(spark, sf):
    b = source(spark, sf, "spellbook_v")
    spell = lambda n: F.concat(F.lit("spell:"), F.col(n))
    cust = lambda kind: F.concat(F.lit(kind + ":"), F.col("cust"))
    nothing = F.lit(None).cast("string")

    def option(kind, spell_id, item_id, status):
        return F.struct(F.lit(kind).alias("kind"), spell_id.alias("spell_id"), item_id.alias("item_id"), status.alias("status"))

    def effect(kind, **given):
        names = ["spell_id", "stat_id", "item_id", "monster_id", "removed_spell_id", "required_spell_id", "forbidden_spell_id", "buff_tag"]
        options = given.pop("options", F.filter(F.array(option("spell", nothing, nothing, nothing)), lambda o: F.lit(False)))
        return F.struct(F.lit(kind).alias("type"), *[given.get(n, nothing).alias(n) for n in names], options.alias("options"))

    effects = F.array(
        effect("trigger", spell_id=spell("half"), required_spell_id=F.when(F.col("quarter") < 2, spell("third")),
               forbidden_spell_id=F.when(F.col("quarter") == 3, spell("fifth"))),
        effect("spawn", monster_id=cust("monster"), removed_spell_id=spell("seventh"), buff_tag=F.when(F.col("quarter") == 1, F.lit("tag"))),
        effect("spawnitemfromlist", item_id=cust("item"), stat_id=F.concat(F.lit("stat:"), F.col("quarter")), options=F.array(
            option("item", nothing, cust("item"), F.when(F.col("quarter") == 0, "resolved").otherwise("unresolved")),
            option("spell", spell("third"), nothing, nothing))))
    hook = F.struct(F.lit("payback").alias("kind"), spell("fifth").alias("spell_id"))
    buff = F.struct(F.array(effect("dot", spell_id=spell("seventh"))).alias("effects"), F.array(hook, hook).alias("hooks"),
                    F.array(F.struct(cust("monster").alias("monster_id"))).alias("polymorphs"))
    none = F.filter(F.array(buff), lambda x: F.lit(False))
    return b.select("id", "canonical_key", effects.alias("effects"), F.when(F.col("has_buff"), F.array(buff)).otherwise(none).alias("buffs"))


LINK = "SELECT '{rel}' AS relation, {target} AS target_id, id AS owner_id, {a} AS at_0, {b} AS at_1 FROM spellbook_v WHERE {where}"
NO = "CAST(NULL AS INT)"
LINKS = {
    "J24_effect_backlinks": ("effect", backlinks.effect_links, [("'spell:' || half", "0", NO, "TRUE"), ("'spell:' || seventh", "3", NO, "has_buff")]),
    "J25_hook_backlinks": ("hook", backlinks.hook_links, [("'spell:' || fifth", "0", "0", "has_buff"), ("'spell:' || fifth", "0", "1", "has_buff")]),
    "J26_option_spell_backlinks": ("option-spell", backlinks.option_spell_links, [("'spell:' || third", "2", "1", "TRUE")]),
    "J27_option_item_backlinks": ("option-item", backlinks.option_item_links, [("'item:' || cust", "2", "0", "quarter = 0")]),
    "J28_item_target_backlinks": ("item-target", backlinks.item_target_links, [("'item:' || cust", "2", NO, "TRUE")]),
    "J29_monster_target_backlinks": ("monster-target", backlinks.monster_target_links, [("'monster:' || cust", "1", NO, "TRUE")]),
    "J30_polymorph_backlinks": ("polymorph", backlinks.polymorph_links, [("'monster:' || cust", "0", "0", "has_buff")]),
    "J31_removed_buff_backlinks": ("removed-buff", backlinks.removed_buff_links, [("'spell:' || seventh", "1", NO, "TRUE")]),
    "J32_condition_backlinks": ("condition", backlinks.condition_links, [("'spell:' || third", "0", NO, "quarter < 2"), ("'spell:' || fifth", "0", NO, "quarter = 3")]),
}
EDGE_COLUMNS = ["relation", "target_id", "owner_id", "at_0", "at_1"]


def _link_sql(relation, parts):
    return " UNION ALL ".join(LINK.format(rel=relation, target=t, a=a, b=b, where=w) for t, a, b, w in parts)


def _link_query(fn):
    return lambda spark, sf: fn(spells(spark, sf)).select(*EDGE_COLUMNS)


for _name, (_relation, _fn, _parts) in LINKS.items():
    query(_name, _link_sql(_relation, _parts))(_link_query(_fn))

VIEWS["edges_v"] = " UNION ALL ".join(_link_sql(relation, parts) for relation, _, parts in LINKS.values())

query("J07_spell_edges", """SELECT relation, count(*) AS edges, count(DISTINCT owner_id) AS owners FROM edges_v GROUP BY relation""")(
    lambda spark, sf: backlinks.spell_edges(spells(spark, sf)).groupBy("relation").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("owner_id").alias("owners")))
query("U07_all_backlinks", """
SELECT * FROM edges_v WHERE target_id IN (SELECT 'spell:' || o_orderkey FROM orders WHERE o_orderstatus = 'P')""")(
    lambda spark, sf: backlinks.backlinks_of(
        backlinks.spell_edges(spells(spark, sf)), "spell",
        table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("spell:"), "o_orderkey").alias("id"))).select(*EDGE_COLUMNS))
query("A11_backlink_totals", "SELECT target_id, count(*) AS backlinks FROM edges_v GROUP BY target_id")(
    lambda spark, sf: backlinks.backlink_totals(backlinks.spell_edges(spells(spark, sf))).select("target_id", "backlinks"))


@query("J33_page_backlinks", """
SELECT relation, 'spell:' || l_suppkey AS target_id, owner_id FROM (
  SELECT l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'item-trigger' WHEN 1 THEN 'macguffin' ELSE 'monster-trigger' END AS relation,
    CASE l_linenumber % 3 WHEN 2 THEN 'monster:' ELSE 'item:' END || l_partkey AS owner_id FROM lineitem)""")
def page_backlinks(spark, sf):
    line = table(spark, sf, "lineitem")
    reference = F.array(F.struct(F.concat(F.lit("spell:"), "l_suppkey").alias("target_id")))

    def owners(kind, remainder):
        return line.filter(F.expr(f"l_linenumber % 3 = {remainder}")).select(
            F.concat(F.lit(kind + ":"), "l_partkey").alias("id"), F.lit("k").alias("canonical_key"), reference.alias("refs"))

    parts = [backlinks.owner_links(owners("item", 0), "item-trigger", "refs"), backlinks.owner_links(owners("item", 1), "macguffin", "refs"),
             backlinks.owner_links(owners("monster", 2), "monster-trigger", "refs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("relation", "target_id", "owner_id")


def stat_uses(spark, sf):
    return linking.link_modifiers(source(spark, sf, "modifiers_v"), linking.selector_table(source(spark, sf, "stats_v")))


VIEWS["stat_uses_v"] = """
SELECT m.owner_kind, m.owner_id, s.stat_id, m.amount, m.position FROM modifiers_v m JOIN (SELECT modifier_kind, source_key, min(id) AS stat_id FROM stats_v
  WHERE modifier_kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) s USING (modifier_kind, source_key)"""
query("J34_stat_owners", "SELECT DISTINCT stat_id, owner_kind, owner_id FROM stat_uses_v")(
    lambda spark, sf: backlinks.page_stat_owners(stat_uses(spark, sf)))
query("J34_stat_values", """SELECT stat_id, owner_kind, owner_id, string_agg(CAST(CAST(amount AS BIGINT) AS VARCHAR), ',' ORDER BY position, amount) AS amounts FROM stat_uses_v GROUP BY ALL""")(
    lambda spark, sf: backlinks.stat_values(stat_uses(spark, sf)).select(
        "stat_id", "owner_kind", "owner_id", F.array_join(F.transform("amounts", lambda a: a.cast("bigint").cast("string")), ",").alias("amounts")))
query("J35_monster_variants", """
SELECT c.part_no AS child, p.part_no AS parent FROM parents_v c JOIN parents_v p ON p.part_no = c.parent_no""")(
    lambda spark, sf: backlinks.owner_links(
        source(spark, sf, "parents_v").select(F.col("part_no").alias("id"), F.col("label").alias("canonical_key"), F.array(F.struct(
            F.when(F.col("parent_no") < 900000000, F.col("parent_no")).alias("target_id"))).alias("refs")), "inherits", "refs", "monster").select(
        F.col("owner_id").alias("child"), F.col("target_id").alias("parent")))
query("J35_template_owners", """SELECT 'spell:' || c_custkey AS spell_id, 'template:' || n_regionkey AS template_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0""")(
    lambda spark, sf: backlinks.backlinks_of(backlinks.owner_links(
        table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("spell:"), "c_custkey").alias("id"), F.col("c_name").alias("canonical_key"),
            F.array(F.struct(F.when(F.expr("c_custkey % 3 <> 0"), F.concat(F.lit("template:"), "n_regionkey")).alias("target_id"))).alias("refs")), "targeting", "refs", "template"),
        "template", table(spark, sf, "region").select(F.concat(F.lit("template:"), "r_regionkey").alias("id"))).select(F.col("owner_id").alias("spell_id"), F.col("target_id").alias("template_id")))
query("J38_skill_by_source_id", """
SELECT p_brand AS file, p_name AS skill_name, count(*) AS abilities FROM part JOIN (SELECT l_partkey % 500 AS ref, 'Brand#' || (l_suppkey % 25) AS file FROM lineitem) a
  ON a.ref = p_partkey AND a.file = p_brand GROUP BY ALL""")(
    lambda spark, sf: backlinks.abilities_by_source_skill(
        table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("source_skill_id"), F.col("p_name").alias("name")),
        table(spark, sf, "lineitem").select(F.concat(F.lit("Brand#"), F.expr("l_suppkey % 25")).alias("file"), F.expr("l_partkey % 500").alias("skill_ref"),
                                            F.lit("a").alias("name"))).groupBy("file", "skill_name").agg(F.count(F.lit(1)).alias("abilities")))
query("J42_craft_requirements", """
SELECT l_orderkey AS craft_id, l_linenumber AS output_index, unnest(CASE l_suppkey % 4 WHEN 0 THEN ['Wand Crafting'] WHEN 1 THEN ['Alchemy', 'Tinkering']
  WHEN 2 THEN ['Smithing'] ELSE [] END) AS stat, l_quantity AS skill FROM lineitem""")(
    lambda spark, sf: backlinks.craft_requirements(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("craft_id"), F.col("l_linenumber").alias("output_index"), F.col("l_quantity").alias("skill"),
        F.expr("element_at(array('lathe', 'grinder', 'smithing', 'unknown'), cast(1 + l_suppkey % 4 AS int))").alias("tool"))))
query("A12_declaration_counts", """
SELECT id, CASE WHEN has_buff THEN 1 ELSE 0 END AS buffs, CASE WHEN has_buff THEN 2 ELSE 0 END AS hooks, CASE WHEN has_buff THEN 1 ELSE 0 END AS polymorphs,
  CASE WHEN has_buff THEN 1 ELSE 0 END AS buff_effects, 1 AS list_effects, 2 AS list_options, CASE WHEN quarter = 1 THEN 1 ELSE 0 END AS tagged_effects FROM spellbook_v""")(
    lambda spark, sf: backlinks.declaration_counts(spells(spark, sf)))


@query("A13_toolkit_coverage", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS states, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END AS coordinates,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS controls FROM orders""")
def toolkit_coverage(spark, sf):
    control = lambda path, x: F.struct(path.alias("path"), x.alias("x"), F.lit(None).cast("int").alias("y"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), backlinks.toolkit_coverage(
        F.array(F.lit("a"), none, F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'b' END")),
        F.array(F.lit(1), F.lit(2), F.lit(3), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 4 END")),
        F.array(control(F.lit("p"), F.lit(None).cast("int")), control(none, F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN 1 END"))),
    ).alias("c")).select("id", "c.*")


@query("J08_link_monsters", """
SELECT c.part_no AS monster, coalesce(i.icon, '') AS icon, x.path, CASE WHEN x.path = 'trigger' THEN CASE WHEN s.s_suppkey IS NOT NULL THEN 'spell:' || s.s_suppkey END ELSE k.target_id END AS target_id
FROM parents_v c JOIN (SELECT start AS part_no, arg_min(icon, far) FILTER (icon IS NOT NULL) AS icon FROM above_v GROUP BY start) i USING (part_no)
CROSS JOIN (SELECT unnest(['trigger', 'drop']) AS path) x LEFT JOIN supplier s ON s.s_suppkey = c.part_no % 150
LEFT JOIN edge_aliases_v k ON k.alias = 'part ' || c.part_no""")
def link_monsters(spark, sf):
    """Inheritance first, then triggers to spells and named drops to items."""
    from .plan_queries import _inherited

    resolved, _ = _inherited(spark, sf)
    edge = lambda path, kind, key: F.struct(F.lit(path).alias("path"), F.lit(kind).alias("target_kind"), key.alias("key"))
    edges = resolved.select(F.col("key").alias("monster"), F.coalesce("icon", F.lit("")).alias("icon"), F.explode(F.array(
        edge("trigger", "spell", F.concat(F.lit("supplier "), F.col("key") % 150)), edge("drop", "item", F.concat(F.lit("part "), F.col("key"))))).alias("e")).select(
        "monster", "icon", "e.path", "e.target_kind", "e.key")
    spells_named = table(spark, sf, "supplier").select(F.lit("spell").alias("kind"), F.concat(F.lit("supplier "), "s_suppkey").alias("alias"),
                                                      F.concat(F.lit("spell:"), "s_suppkey").alias("target_id"))
    return linking.link(edges, item_aliases(spark, sf).unionByName(spells_named)).select("monster", "icon", "path", "target_id")
