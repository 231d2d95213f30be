"""Documents, ranked search, suggestions, facets, browsing and catalogues."""

from pyspark.sql import functions as F

from ..operators import backlinks, catalogue, ordering, quality, reports, search
from ..operators.search import SearchQuery
from . import views  # noqa: F401
from .link_queries import toolkits
from .registry import VIEWS, query, source, table

VIEWS["documents_v"] = """
SELECT id, kind, name, coalesce(description, '') AS summary, source_id, category, stat_key, alias, skill_level, lower(name) AS search_name,
  '/' || CASE kind WHEN 'ability' THEN 'abilities' ELSE kind || 's' END || '/' || slug AS url,
  lower(concat_ws(' ', name, alias, coalesce(description, ''), kind, coalesce(category, ''), source_id,
    CASE WHEN kind IN ('recipe', 'encrustment') THEN 'source skill ' || skill_level END)) AS text
FROM entities_v"""


def entities(spark, sf):
    raw = source(spark, sf, "entities_v")
    listed = lambda name: F.filter(F.array(name), lambda v: v.isNotNull())
    return raw.withColumn("aliases", listed("alias")).withColumn("stat_keys", listed("stat_key")).withColumn(
        "column", F.col("col")).withColumn("extra_parts", F.array().cast("array<string>"))


def documents(spark, sf):
    return search.build_documents(entities(spark, sf))


@query("Q-S1_search_documents", "SELECT id, kind, name, summary, source_id, category, skill_level, url, text FROM documents_v")
def search_documents(spark, sf):
    return documents(spark, sf).select("id", "kind", "name", "summary", "source_id", "category", "skill_level", "url", "text")


@query("T02_document_order", "SELECT id, kind, row_number() OVER (ORDER BY kind, name, id) AS row_number FROM documents_v")
def document_order(spark, sf):
    return ordering.numbered(documents(spark, sf), [], search.document_order()).select("id", "kind", "row_number")


QUERIES = [
    SearchQuery("exact", "Red  Widget"), SearchQuery("prefix", "red"), SearchQuery("tokens", "widget economy"),
    SearchQuery("inside", "widget"), SearchQuery("filtered", "goods", kinds=["item"], source_ids=["Brand#3", "Brand#4"]),
    SearchQuery("category", "", category="gem"), SearchQuery("stat", "", stat_key="stat 4"),
    SearchQuery("skill", "brew", kinds=["recipe", "encrustment"], max_skill=1), SearchQuery("none", "smlal ring"),
    SearchQuery("misspelt", "rde widget"), SearchQuery("short", "zz"), SearchQuery("monster", "lurks building"),
]


def _condition(q):
    text = " ".join(q.query.lower().split())
    parts = [f"contains(text, '{t}')" for t in text.split(" ") if t]
    if q.kinds:
        parts.append("kind IN (" + ", ".join(f"'{k}'" for k in q.kinds) + ")")
    if q.source_ids:
        parts.append("source_id IN (" + ", ".join(f"'{k}'" for k in q.source_ids) + ")")
    if q.category:
        parts.append(f"category = '{q.category}'")
    if q.stat_key:
        parts.append(f"stat_key = '{q.stat_key}'")
    if q.max_skill is not None:
        parts.append(f"skill_level <= {q.max_skill}")
    return text, " AND ".join(parts) or "TRUE"


def _score(text):
    if not text:
        return "0"
    tokens = " + ".join(f"CASE WHEN contains(search_name, '{t}') THEN 20 ELSE 2 END" for t in text.split(" "))
    return (f"CASE WHEN search_name = '{text}' THEN 300 WHEN starts_with(search_name, '{text}') THEN 200 "
            f"WHEN contains(search_name, '{text}') THEN 100 ELSE 0 END + {tokens}")


def search_sql(queries, columns="query_id, id, kind, name, score"):
    parts = []
    for q in queries:
        text, where = _condition(q)
        parts.append(f"SELECT '{q.id}' AS query_id, id, kind, name, CAST({_score(text)} AS BIGINT) AS score FROM documents_v WHERE {where}")
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


query("Q-S4_search", search_sql(QUERIES))(
    lambda spark, sf: search.search(documents(spark, sf), QUERIES).select("query_id", "id", "kind", "name", "score"))
query("Q-S3_text_score", search_sql(QUERIES[:4], "query_id, id, score"))(
    lambda spark, sf: search.matches(documents(spark, sf), QUERIES[:4]).select("query_id", "id", "score"))
FILTERS = [q for q in QUERIES if not q.query or q.kinds]
query("P01_search_filter", search_sql(FILTERS, "query_id, id"))(
    lambda spark, sf: search.matches(documents(spark, sf), FILTERS).select("query_id", "id"))
query("P02_token_containment", "SELECT id FROM documents_v WHERE contains(text, 'widget') AND contains(text, 'econ')")(
    lambda spark, sf: documents(spark, sf).filter(search.contains_tokens(F.col("text"), "widget econ")).select("id"))
query("P04_crafting_scope", "SELECT id FROM documents_v WHERE kind IN ('recipe', 'encrustment')")(
    lambda spark, sf: search.matches(documents(spark, sf), search.SAVED_VIEWS[:1]).select("id"))
query("P05_saved_views", search_sql(search.SAVED_VIEWS, "query_id, id"))(
    lambda spark, sf: search.matches(documents(spark, sf), search.SAVED_VIEWS).select("query_id", "id"))
TOP = [SearchQuery("top-widget", "widget", limit=7), SearchQuery("top-brew", "brew 1", limit=12)]
query("T01_top_results", f"""SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, name, id) AS r
  FROM ({search_sql(TOP)})) WHERE r <= CASE query_id WHEN 'top-widget' THEN 7 ELSE 12 END""")(
    lambda spark, sf: search.search(documents(spark, sf), TOP).select("query_id", "id", "score"))


def query_table(spark, sf):
    """One query per customer: its name and a word, some of them filtered or limited."""
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("query_id"), F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, " on").otherwise("")).alias("query"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("item"), F.lit("monster"))).alias("kinds"), F.lit(None).cast("array<string>").alias("source_ids"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("stat_key"),
        F.when(F.col("c_custkey") % 5 == 0, 3).cast("bigint").alias("max_skill"), F.when(F.col("c_custkey") % 2 == 0, 2).cast("bigint").alias("limit"))


query("Q-S4_search_table", """SELECT query_id, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, name, id) AS r FROM (
    SELECT c_name AS query_id, c_custkey, id, kind, name, CAST(CASE WHEN search_name = q THEN 300 WHEN starts_with(search_name, q) THEN 200 WHEN contains(search_name, q) THEN 100 ELSE 0 END
      + CASE WHEN contains(search_name, t) THEN 20 ELSE 2 END + CASE WHEN c_custkey % 3 <> 0 THEN 0 WHEN contains(search_name, 'on') THEN 20 ELSE 2 END AS BIGINT) AS score
    FROM documents_v JOIN (SELECT *, lower(c_name) AS t, lower(c_name) || CASE WHEN c_custkey % 3 = 0 THEN ' on' ELSE '' END AS q FROM customer) ON contains(text, t)
    WHERE (c_custkey % 3 <> 0 OR contains(text, 'on')) AND (c_custkey % 4 <> 0 OR kind IN ('item', 'monster')) AND (c_custkey % 5 <> 0 OR skill_level <= 3)))
WHERE c_custkey % 2 <> 0 OR r <= 2""")(
    lambda spark, sf: search.search_table(documents(spark, sf), query_table(spark, sf)).select("query_id", "id", "score"))

MISSPELT = [SearchQuery("ring", "smlal ring"), SearchQuery("widget", "rde widget"), SearchQuery("two", "grean bolt", limit=2), SearchQuery("found", "red widget"),
            SearchQuery("custom", "customr#000000007"), SearchQuery("kind", "smlal ring", kinds=["monster"]), SearchQuery("alias", "econmy-7"), SearchQuery("tiny", "zq")]


def suggest_sql(queries):
    parts = []
    for q in queries:
        text, where = _condition(q)
        filters = " AND ".join(p for p in where.split(" AND ") if not p.startswith("contains(text")) or "TRUE"
        limit = min(5, q.limit if q.limit is not None else 5)
        gap = f"abs(length(value) - {len(text)})"
        bound = f"greatest(1, least(5, floor(greatest(length(value), {len(text)}) * 0.25)))"
        parts.append(f"""SELECT '{q.id}' AS query_id, * FROM (SELECT *, row_number() OVER (ORDER BY distance, gap, is_alias, kind, name, id) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY search_name ORDER BY distance, gap, is_alias, kind, name, id) AS dup FROM (
            SELECT id, kind, name, search_name, distance, gap, is_alias, row_number() OVER (PARTITION BY id ORDER BY distance, gap, is_alias) AS best FROM (
              SELECT id, kind, name, search_name, is_alias, {gap} AS gap, levenshtein(value, '{text}') AS distance FROM names_v
              WHERE {len(text)} BETWEEN 3 AND 120 AND {filters} AND {gap} <= {bound} AND levenshtein(value, '{text}') <= {bound}
                AND NOT EXISTS (SELECT 1 FROM documents_v WHERE {where})) ) WHERE best = 1) WHERE dup = 1) WHERE rank <= {limit}""")
    return "SELECT query_id, CAST(rank AS INT) AS rank, id, name, CAST(distance AS INT) AS distance FROM (" + " UNION ALL ".join(parts) + ")"


VIEWS["names_v"] = """
SELECT *, search_name AS value, 0 AS is_alias FROM documents_v
UNION ALL SELECT *, trim(regexp_replace(replace(replace(lower(alias), '-', ' '), '_', ' '), '\\s+', ' ', 'g')), 1 FROM documents_v WHERE alias IS NOT NULL"""
query("Q-S5_suggestions", suggest_sql(MISSPELT))(
    lambda spark, sf: search.suggest(documents(spark, sf), MISSPELT).select("query_id", "rank", "id", "name", "distance"))
query("T03_suggestion_order", suggest_sql(MISSPELT[:3]))(
    lambda spark, sf: search.suggest(documents(spark, sf), MISSPELT[:3]).select("query_id", "rank", "id", "name", "distance"))
query("W09_suggestion_dedupe", f"SELECT query_id, lower(name) AS name FROM ({suggest_sql(MISSPELT[:2])})")(
    lambda spark, sf: search.suggest(documents(spark, sf), MISSPELT[:2]).select("query_id", F.lower("name").alias("name")))


def misspelt_names(spark, sf):
    """One query per customer: a part's name with its second letter gone and the last one doubled, some of them filtered or limited."""
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    parts = p.groupBy().agg(F.count(F.lit(1)).alias("n"))
    named = c.join(parts, how="cross").withColumn("p_partkey", F.col("c_custkey") % F.col("n")).join(p.select("p_partkey", "p_name"), "p_partkey")
    return named.select(
        F.col("c_name").alias("query_id"), F.expr("concat(substr(p_name, 1, 1), substr(p_name, 3), substr(p_name, length(p_name)))").alias("query"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("item"), F.lit("monster"))).alias("kinds"), F.lit(None).cast("array<string>").alias("source_ids"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("stat_key"), F.when(F.col("c_custkey") % 5 == 0, 3).cast("bigint").alias("max_skill"), F.when(F.col("c_custkey") % 2 == 0, 2).cast("bigint").alias("limit"))


query("Q-S5_suggestions_table", """
WITH asked AS (SELECT c_name AS query_id, c_custkey, lower(substr(p_name, 1, 1) || substr(p_name, 3) || substr(p_name, length(p_name))) AS q FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part)),
texts AS (SELECT DISTINCT q FROM asked),
near AS (SELECT q, value, abs(length(value) - length(q)) AS gap, levenshtein(value, q) AS distance FROM texts JOIN (SELECT DISTINCT value FROM names_v) n
  ON abs(length(value) - length(q)) <= greatest(1, least(5, floor(greatest(length(value), length(q)) * 0.25))) AND levenshtein(value, q) <= greatest(1, least(5, floor(greatest(length(value), length(q)) * 0.25)))),
passing AS (SELECT a.query_id, a.c_custkey, d.id, d.kind, d.name, d.search_name, n.distance, n.gap, d.is_alias FROM asked a JOIN near n USING (q) JOIN names_v d ON d.value = n.value
  WHERE (a.c_custkey % 4 <> 0 OR d.kind IN ('item', 'monster')) AND (a.c_custkey % 5 <> 0 OR d.skill_level <= 3)),
tokens AS (SELECT query_id, c_custkey, unnest(string_split(q, ' ')) AS t, len(string_split(q, ' ')) AS n FROM asked),
answered AS (SELECT query_id FROM (SELECT t.query_id, d.id, count(DISTINCT t.t) AS k, any_value(t.n) AS n FROM tokens t JOIN documents_v d ON contains(d.text, t.t)
  WHERE (t.c_custkey % 4 <> 0 OR d.kind IN ('item', 'monster')) AND (t.c_custkey % 5 <> 0 OR d.skill_level <= 3) GROUP BY t.query_id, d.id) WHERE k = n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, gap, is_alias, kind, name, id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, search_name ORDER BY distance, gap, is_alias, kind, name, id) AS dup FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY distance, gap, is_alias) AS best FROM passing WHERE query_id NOT IN (SELECT query_id FROM answered)) WHERE best = 1) WHERE dup = 1)
SELECT query_id, CAST(rank AS INT) AS rank, id, CAST(distance AS INT) AS distance FROM ranked WHERE rank <= CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 5 END""")(
    lambda spark, sf: search.suggest_table(documents(spark, sf), misspelt_names(spark, sf)).select("query_id", "rank", "id", "distance"))


@query("W10_closest_candidate", """
SELECT id, arg_min(distance, d) AS distance, arg_min(gap, d) AS gap, arg_min(is_alias, d) AS is_alias FROM (
  SELECT *, CAST(distance * 10000 + gap * 10 + is_alias AS BIGINT) AS d FROM (
    SELECT id, CAST(is_alias AS INT) AS is_alias, CAST(abs(length(value) - 8) AS INT) AS gap, CAST(levenshtein(value, 'economy8') AS INT) AS distance, length(value) AS len FROM names_v)
  WHERE gap <= greatest(1, least(5, floor(greatest(len, 8) * 0.25))) AND distance <= greatest(1, least(5, floor(greatest(len, 8) * 0.25)))) GROUP BY id""")
def closest_candidate(spark, sf):
    docs = search.with_search_name(documents(spark, sf)).withColumn(
        "search_aliases", F.transform("aliases", lambda a: F.regexp_replace(F.lower(a), "[-_]", " ")))
    near = docs.select("id", search.closest("economy8").alias("n")).filter("n is not null")
    return near.select("id", "n.distance", "n.gap", F.col("n.alias").alias("is_alias"))


# Historical search over raw names, and the prose table at volume.
query("P08_name_search", "SELECT kind, name, id FROM entities_v WHERE kind IN ('item', 'spell') AND contains(lower(name), 'r#0000000') OR kind IN ('item', 'spell') AND contains(lower(name), 'widg')")(
    lambda spark, sf: search.name_search(entities(spark, sf).filter("kind in ('item', 'spell')"), "R#0000000").unionByName(
        search.name_search(entities(spark, sf).filter("kind in ('item', 'spell')"), "WIDG")).select("kind", "name", "id"))
PROSE = [SearchQuery("common", "the"), SearchQuery("pair", "the and"), SearchQuery("rare", "license")]
query("Q-S4_search_prose", " UNION ALL ".join(
    f"SELECT '{q.id}' AS query_id, doc_id FROM documents WHERE " + " AND ".join(f"contains(lower(text), '{t}')" for t in q.query.split()) for q in PROSE))(
    lambda spark, sf: search.matches(table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit("item").alias("kind"), F.concat(F.lit("document "), "doc_id").alias("name"), F.col("lang").alias("category"),
        F.col("source").alias("source_id"), F.lit(None).cast("bigint").alias("skill_level"), F.array().cast("array<string>").alias("stat_keys"),
        F.lower("text").alias("text")), PROSE).select("query_id", F.col("id").alias("doc_id")))


# ---- stat keys and facets ----------------------------------------------------------------

VIEWS["stat_key_rows_v"] = """
SELECT DISTINCT m.owner_id, coalesce(s.canonical_key, 'modifier:' || m.modifier_kind || ':' || m.source_key) AS stat_key FROM modifiers_v m
LEFT JOIN (SELECT modifier_kind, source_key, max(canonical_key) AS canonical_key FROM stats_v WHERE modifier_kind IS NOT NULL GROUP BY 1, 2) s USING (modifier_kind, source_key)"""


def stat_key_rows(spark, sf):
    uses = source(spark, sf, "modifiers_v").select("owner_id", "modifier_kind", "source_key", F.lit(None).cast("string").alias("stat_id"),
                                                  F.lit(None).cast("string").alias("stat_key"))
    return search.stat_key_rows(uses, source(spark, sf, "stats_v"))


query("Q-S2_stat_keys", "SELECT owner_id, stat_key FROM stat_key_rows_v")(stat_key_rows)
query("A08_stat_facets", """
SELECT value, min(label) AS label FROM (SELECT coalesce(s.canonical_key, k.stat_key) AS value, coalesce(s.name, CASE split_part(k.stat_key, ':', 2)
  WHEN 'damage' THEN split_part(k.stat_key, ':', 3) || ' damage' WHEN 'resistance' THEN split_part(k.stat_key, ':', 3) || ' resistance'
  WHEN 'primary' THEN 'Primary attribute ' || split_part(k.stat_key, ':', 3) ELSE 'Secondary stat ' || split_part(k.stat_key, ':', 3) END) AS label
  FROM (SELECT DISTINCT stat_key FROM stat_key_rows_v) k LEFT JOIN stats_v s ON s.canonical_key = k.stat_key) GROUP BY value""")(
    lambda spark, sf: search.stat_facets(source(spark, sf, "stats_v"), stat_key_rows(spark, sf)))


def _facets(scope):
    return lambda spark, sf: search.category_facets(documents(spark, sf), scope).select("group_id", "value", "label")


FACET_SQL = """
SELECT DISTINCT CASE kind WHEN 'item' THEN 'item-categories' WHEN 'monster' THEN 'monster-taxonomies' WHEN 'stat' THEN 'stat-groups' ELSE 'crafting-tools' END AS group_id,
  category AS value, CASE category WHEN 'weapon:sword' THEN 'Sword weapon' WHEN 'armour:ring' THEN 'Ring' ELSE
  array_to_string(list_transform(list_filter(regexp_split_to_array(category, '[ _-]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') END AS label
FROM documents_v WHERE category IS NOT NULL {more}"""
query("A07_category_groups", FACET_SQL.format(more=""))(_facets("all"))
query("A07_category_groups_crafting", FACET_SQL.format(more="AND kind IN ('recipe', 'encrustment')"))(_facets("crafting"))
query("A09_skill_facet", "SELECT DISTINCT skill_level FROM documents_v WHERE skill_level IS NOT NULL")(
    lambda spark, sf: search.skill_facet(documents(spark, sf)))

REQUESTS = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'item' WHEN 1 THEN 'crafting' WHEN 2 THEN 'odd' ELSE 'recipe' END AS kind,
  CASE o_orderkey % 3 WHEN 0 THEN 'Brand#3' ELSE 'nobody' END AS source, CASE o_orderkey % 5 WHEN 0 THEN 'gem' WHEN 1 THEN '2-high' ELSE 'none' END AS category,
  CASE o_orderkey % 2 WHEN 0 THEN 'stat 4' ELSE 'stat x' END AS stat, CAST(o_orderkey % 9 AS STRING) AS skill FROM orders"""
VIEWS["requests_v"] = REQUESTS


@query("Q-S6_scope_repair", """
SELECT request_id, CASE WHEN kind = 'odd' THEN 'all' ELSE kind END AS kind, CASE WHEN source = 'Brand#3' THEN source ELSE 'all' END AS source,
  CASE WHEN category = 'gem' AND kind IN ('item', 'odd') THEN 'gem' WHEN category = '2-high' AND kind <> 'item' THEN category ELSE 'all' END AS category,
  CASE WHEN stat = 'stat 4' THEN stat ELSE 'all' END AS stat, CASE WHEN kind <> 'item' AND CAST(skill AS INT) < 6 THEN skill ELSE 'all' END AS skill FROM requests_v""")
def scope_repair(spark, sf):
    docs = documents(spark, sf)
    options = docs.select(F.explode("stat_keys").alias("value")).distinct().select("value", F.array("value").alias("aliases"))
    return search.repair_scope(source(spark, sf, "requests_v"), docs, docs.select(F.col("source_id").alias("id")), options)


# ---- orders and pages ------------------------------------------------------------------------

VIEWS["shelf_v"] = """
SELECT e.*, coalesce(CAST(s.precedence AS BIGINT), 9007199254740991) AS source_rank FROM entities_v e LEFT JOIN sources_v s ON s.id = e.source_id"""
GAME = "source_rank, source_id, file, line, id"


def shelf(spark, sf):
    return ordering.with_precedence(entities(spark, sf), source(spark, sf, "sources_v"))


def items(spark, sf):
    return shelf(spark, sf).filter("kind = 'item'")


def _ranked(order_sql, kind):
    return f"SELECT id, name, source_id, row_number() OVER (ORDER BY {order_sql}) AS row_number FROM shelf_v WHERE kind = '{kind}'"


def _numbered(df, order):
    return ordering.numbered(df, [], order).select("id", "name", "source_id", "row_number")


for _sort, _order in {"game": GAME, "name": f"lower(name), name, {GAME}", "quality": f"quality, {GAME}", "price": f"price NULLS LAST, {GAME}"}.items():
    query(f"T06_items_by_{_sort}", _ranked(_order, "item"))(
        lambda spark, sf, s=_sort: _numbered(items(spark, sf), ordering.item_order(s)))
query("T05_game_order", f"SELECT id, row_number() OVER (PARTITION BY kind ORDER BY {GAME}) AS row_number FROM shelf_v")(
    lambda spark, sf: ordering.numbered(shelf(spark, sf), ["kind"], ordering.game_order()).select("id", "row_number"))
query("T07_recipes_by_skill", _ranked(f"skill_level, {GAME}", "recipe"))(
    lambda spark, sf: _numbered(shelf(spark, sf).filter("kind = 'recipe'").withColumn("lowest_skill", F.col("skill_level")), ordering.item_order("skill")))
query("T11_by_source", _ranked("source_rank, line, id", "item"))(
    lambda spark, sf: _numbered(items(spark, sf).withColumn("record", F.col("line")), [*ordering.source_record_order(), "id"]))
query("W08_browse_pages", "SELECT id, CAST(ceil(row_number() OVER (PARTITION BY kind ORDER BY name, id) / 100.0) AS BIGINT) AS page FROM documents_v")(
    lambda spark, sf: ordering.with_pages(documents(spark, sf), ["kind"], search.document_order()[1:], catalogue.BROWSE_PAGE).select("id", "page"))
query("W08_catalogue_page", f"SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY lower(name), name, {GAME}) AS r FROM shelf_v WHERE kind = 'item' AND category = 'gem') WHERE r BETWEEN 37 AND 72")(
    lambda spark, sf: ordering.one_page(catalogue.in_category(items(spark, sf), "gem"), ordering.item_order("name"), 2, 36).select("id", "name"))
query("P06_category_filter", "SELECT id FROM shelf_v WHERE kind = 'item' AND category = 'weapon:sword' UNION ALL SELECT id FROM shelf_v WHERE kind = 'recipe' AND category = '2-high'")(
    lambda spark, sf: catalogue.in_category(items(spark, sf), "weapon:sword").select("id").unionByName(
        catalogue.with_tool(shelf(spark, sf).filter("kind = 'recipe'").withColumn("tool", F.upper("category")), "2-high").select("id")))

VIEWS["categories_v"] = f"""
SELECT category, replace(category, ':', '-') AS segment, CASE category WHEN 'weapon:sword' THEN 'Sword weapon' WHEN 'armour:ring' THEN 'Ring' ELSE upper(category[1:1]) || category[2:] END AS label,
  CASE category WHEN 'weapon:sword' THEN 'Weapons' WHEN 'armour:ring' THEN 'Armour & equipment' WHEN 'food' THEN 'Food & drink' WHEN 'trap' THEN 'Tools & devices'
    WHEN 'gem' THEN 'Crafting materials' ELSE 'Other' END AS catalogue_group, count(*) AS item_count, CAST(greatest(1, ceil(count(*) / 36.0)) AS BIGINT) AS pages,
  max(CASE WHEN r = 1 THEN id END) AS first_item
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {GAME}) AS r FROM shelf_v WHERE kind = 'item') GROUP BY category"""


def categories(spark, sf):
    return catalogue.item_categories(entities(spark, sf).filter("kind = 'item'"), source(spark, sf, "sources_v"))


query("A04_item_categories", "SELECT * FROM categories_v")(categories)
query("T13_default_category", "SELECT category FROM categories_v WHERE category = 'weapon:sword'")(
    lambda spark, sf: catalogue.default_category(categories(spark, sf)).select("category"))
query("Q05_category_segments", "SELECT category FROM categories_v WHERE NOT regexp_full_match(category, '[a-z0-9]+([-:][a-z0-9]+)*')")(
    lambda spark, sf: catalogue.category_segment_issues(categories(spark, sf)))

VIEWS["tools_v"] = """
SELECT lower(r.tool) AS tag, regexp_replace(lower(r.tool), '[^a-z0-9]+', '-', 'g') AS segment, coalesce(max(t.name), array_to_string(list_transform(
  list_filter(regexp_split_to_array(lower(r.tool), '[ _-]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ')) AS label,
  count(*) AS recipe_count, CAST(greatest(1, ceil(count(*) / 36.0)) AS BIGINT) AS pages, max(t.id) AS first_item
FROM recipes_v r LEFT JOIN (SELECT tag_key, arg_min(id, canonical_key || chr(1) || id) AS id, arg_min(name, canonical_key || chr(1) || id) AS name FROM toolkits_v GROUP BY tag_key) t
  ON t.tag_key = lower(r.tool) GROUP BY lower(r.tool)"""


def tools(spark, sf):
    kits = toolkits(spark, sf)
    return catalogue.craft_tools(source(spark, sf, "recipes_v"), backlinks.toolkit_tags(kits), kits.select("id", "name"))


query("A05_craft_tools", "SELECT * FROM tools_v")(tools)
query("T13_default_tool", "SELECT tag FROM tools_v ORDER BY label, tag LIMIT 1")(lambda spark, sf: catalogue.default_tool(tools(spark, sf)).select("tag"))
query("A06_kind_counts", """SELECT k.kind, CAST(coalesce(n, 0) AS BIGINT) AS entity_count FROM (SELECT unnest(['item','recipe','encrustment','skill','ability','spell','monster','stat','template']) AS kind) k
  LEFT JOIN (SELECT kind, count(*) AS n FROM entities_v GROUP BY kind) USING (kind)""")(
    lambda spark, sf: catalogue.kind_counts(entities(spark, sf)).select("kind", "entity_count"))
query("A10_dataset_totals", """SELECT (SELECT count(*) FROM entities_v) AS entities, (SELECT count(*) FROM lineitem) AS overrides, (SELECT count(*) FROM orders) AS patches""")(
    lambda spark, sf: catalogue.dataset_totals(entities(spark, sf), table(spark, sf, "lineitem"), table(spark, sf, "orders")))
query("A19_sections", "SELECT category, id, count(*) OVER (PARTITION BY category) AS section_size FROM entities_v WHERE kind = 'item'")(
    lambda spark, sf: catalogue.sections(items(spark, sf), "category", F.length("category"), [F.col("source_rank"), F.col("line")]).select("category", "id", "section_size"))
SECTION = """CASE WHEN kind IN ('item', 'recipe', 'encrustment', 'stat') THEN category WHEN kind = 'monster' THEN CASE WHEN line % 9 = 0 THEN 'Special' WHEN line % 20 BETWEEN 1 AND 15 THEN CAST(line % 20 AS STRING) ELSE '?' END
  ELSE upper(substr(name, 1, 1)) END"""
SECTION_RANK = "CASE WHEN kind <> 'monster' THEN 0 WHEN line % 9 = 0 THEN 16 WHEN line % 20 BETWEEN 1 AND 15 THEN line % 20 ELSE 17 END"


@query("A19_all_sections", f"""SELECT kind, id, section, section_number, section_size, position, count(*) OVER (PARTITION BY kind) AS kind_size FROM (
  SELECT *, dense_rank() OVER (PARTITION BY kind ORDER BY rank, section) AS section_number, count(*) OVER (PARTITION BY kind, section) AS section_size,
    row_number() OVER (PARTITION BY kind, section ORDER BY source_id, line, id) AS position
  FROM (SELECT kind, id, line, source_id, {SECTION} AS section, {SECTION_RANK} AS rank FROM entities_v))""")
def all_sections(spark, sf):
    """Items by type, crafts by tool, monsters by depth, spells by letter, stats by group, by one rule table."""
    records = entities(spark, sf).withColumn("section", F.expr(SECTION)).withColumn("section_rank", F.expr(SECTION_RANK)).select("kind", "id", "line", "source_id", "section", "section_rank")
    return catalogue.section_rows(records, ["source_id", "line", "id"]).select(
        "kind", "id", "section", F.col("section_number").cast("bigint").alias("section_number"), "section_size", F.col("position").cast("bigint").alias("position"), "kind_size")


query("A20_monster_section", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Special' WHEN c_nationkey BETWEEN 1 AND 15 THEN CAST(c_nationkey AS VARCHAR) ELSE '?' END AS section FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select("c_custkey", catalogue.monster_section(F.col("c_nationkey"), F.expr("c_custkey % 9 = 0")).alias("section")))
query("T12_preview_limits", "SELECT o_orderkey, CAST(greatest(0, 6 - o_orderkey % 8) AS INT) AS shown FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", F.size(catalogue.preview(
        F.sequence(F.lit(1), F.lit(9)), F.expr("cast(o_orderkey % 8 AS int)"), 6)).alias("shown")))


# ---- comparison and integrity ---------------------------------------------------------------------

VIEWS["compare_v"] = """
SELECT o_custkey AS comparison_id, o_orderkey AS position, CASE WHEN o_orderkey % 11 = 0 THEN 'nothing' ELSE 'i-' || CAST(o_orderkey % 40 AS STRING) END AS slug FROM orders"""
VIEWS["slots_v"] = """
SELECT comparison_id, id, CAST(row_number() OVER (PARTITION BY comparison_id ORDER BY position) AS INT) AS slot FROM (
  SELECT comparison_id, e.id, min(position) AS position FROM compare_v c JOIN entities_v e ON e.kind = 'item' AND e.slug = c.slug GROUP BY comparison_id, e.id)
QUALIFY slot <= 3"""
VIEWS["cells_v"] = """
SELECT comparison_id, key, slot, string_agg(CASE WHEN amount > 0 THEN '+' ELSE '' END || amount, ', ' ORDER BY position, amount) AS cell FROM slots_v JOIN (
  SELECT 'item:' || l_partkey AS id, 'stat ' || l_linenumber AS key, l_orderkey AS position, CAST(l_quantity AS BIGINT) - 25 AS amount FROM lineitem) v USING (id) GROUP BY ALL"""
VIEWS["wide_v"] = """
SELECT comparison_id, key, max(CASE WHEN slot = 1 THEN cell END) AS c1, max(CASE WHEN slot = 2 THEN cell END) AS c2, max(CASE WHEN slot = 3 THEN cell END) AS c3 FROM cells_v GROUP BY ALL"""
SQL_COMPARE = """
SELECT comparison_id, key, coalesce(c1, 'Not declared') AS cell_1, CASE WHEN width >= 2 THEN coalesce(c2, 'Not declared') END AS cell_2,
  CASE WHEN width >= 3 THEN coalesce(c3, 'Not declared') END AS cell_3
FROM wide_v JOIN (SELECT comparison_id, max(slot) AS width FROM slots_v GROUP BY 1) USING (comparison_id)"""


def comparison(spark, sf):
    compared = entities(spark, sf).filter("kind = 'item'").select("slug", "id")
    slots = reports.compared_slots(source(spark, sf, "compare_v"), compared)
    values = table(spark, sf, "lineitem").select(
        F.concat(F.lit("item:"), "l_partkey").alias("id"), F.concat(F.lit("stat "), "l_linenumber").alias("key"),
        F.concat(F.lit("Stat "), "l_linenumber").alias("label"), F.col("l_orderkey").alias("position"), (F.col("l_quantity").cast("bigint") - 25).alias("amount"))
    return reports.comparison_rows(slots, values)


query("R01_item_comparison", SQL_COMPARE)(lambda spark, sf: comparison(spark, sf).select("comparison_id", "key", "cell_1", "cell_2", "cell_3"))
query("R02_row_differs", f"""SELECT comparison_id, key, cell_2 IS DISTINCT FROM cell_1 AND cell_2 IS NOT NULL OR cell_3 IS NOT NULL AND cell_3 <> cell_1 AS differs FROM ({SQL_COMPARE})""")(
    lambda spark, sf: comparison(spark, sf).select("comparison_id", "key", "differs"))
query("Q01_unique_ids", "SELECT 'p_name' AS rule, p_name AS subject, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'id', id, count(*) FROM entities_v GROUP BY id HAVING count(*) > 1")(
    lambda spark, sf: quality.repeated(table(spark, sf, "part"), ["p_name"], "p_name").unionByName(quality.repeated(entities(spark, sf), ["id"], "id")))
query("Q02_contested_routes", """SELECT kind, route, count(DISTINCT id) AS owners FROM (SELECT kind, slug AS route, id FROM entities_v UNION ALL SELECT kind, alias, id FROM entities_v WHERE alias IS NOT NULL)
  GROUP BY ALL HAVING count(DISTINCT id) > 1""")(
    lambda spark, sf: quality.contested_routes(entities(spark, sf).select("kind", "id", F.explode(F.concat(F.array("slug"), F.col("aliases"))).alias("route"))))
