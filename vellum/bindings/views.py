"""Catalogue-shaped views over the test tables, in SQL that Spark and DuckDB both accept."""

from .registry import VIEWS

VIEWS["candidates_v"] = """
SELECT 'item' AS kind, p_partkey AS part,
  p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 1' ELSE ' +1' END AS name,
  lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 1' ELSE ' +1' END) AS lowered,
  lower(p_type) AS description, p_brand AS category, CAST(floor(p_retailprice) AS BIGINT) AS price,
  CAST(p_size AS BIGINT) AS quality, CAST(p_size AS INT) AS precedence, p_brand AS source_id,
  lower(p_type) || 'DB.xml' AS file, CAST(p_partkey + 1 AS INT) AS line, 1 AS col,
  'P-' || CAST(p_partkey % 100 AS STRING) AS original_id
FROM part"""

VIEWS["texts_v"] = """
SELECT o_orderkey AS row_id, o_orderpriority AS word,
  CASE o_orderkey % 12
    WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '-' || CAST(o_custkey AS STRING)
    WHEN 2 THEN '+5' WHEN 3 THEN ' 7' WHEN 4 THEN '1e3' WHEN 5 THEN '' WHEN 6 THEN CAST(NULL AS STRING)
    WHEN 7 THEN CAST(o_custkey AS STRING) || '.25' WHEN 8 THEN '.5' WHEN 9 THEN '9007199254740993'
    WHEN 10 THEN '-.75' ELSE '12x' END AS number_text,
  CASE o_orderkey % 8 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'true' WHEN 3 THEN 'false' WHEN 4 THEN 'True'
    WHEN 5 THEN '' WHEN 6 THEN CAST(NULL AS STRING) ELSE 'yes' END AS flag_text,
  CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderpriority || '   ' || upper(o_orderstatus) || ' '
    WHEN 1 THEN lower(o_orderpriority) || '_x-' || CAST(o_custkey AS STRING)
    WHEN 2 THEN '+*+' ELSE o_orderpriority || CAST(o_orderkey AS STRING) END AS label_text,
  o_custkey AS number, o_orderstatus AS status
FROM orders"""

VIEWS["entities_v"] = """
SELECT 'item' AS kind, 'item:' || CAST(p_partkey AS STRING) AS id, p_name AS name,
  'i-' || CAST(p_partkey AS STRING) AS slug, lower(p_type) || ' goods' AS description, p_brand AS source_id,
  CASE p_size % 6 WHEN 0 THEN 'weapon:sword' WHEN 1 THEN 'armour:ring' WHEN 2 THEN 'food' WHEN 3 THEN 'gem'
    WHEN 4 THEN 'trap' ELSE lower(p_type) END AS category,
  CAST(NULL AS BIGINT) AS skill_level, lower(p_type) || '-' || CAST(p_partkey % 50 AS STRING) AS alias,
  'stat ' || CAST(p_size % 10 AS STRING) AS stat_key, lower(p_type) || 'DB.xml' AS file, CAST(p_partkey AS INT) AS line, 1 AS col,
  CAST(p_size AS BIGINT) AS quality,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(p_retailprice) AS BIGINT) END AS price
FROM part
UNION ALL
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'encrustment' ELSE 'recipe' END,
  CASE WHEN o_orderkey % 10 = 0 THEN 'encrustment:' ELSE 'recipe:' END || CAST(o_orderkey AS STRING),
  'Brew ' || CAST(o_custkey AS STRING), 'r-' || CAST(o_orderkey AS STRING), '', 'src' || CAST(o_orderkey % 5 AS STRING),
  lower(o_orderpriority), o_orderkey % 6, 'brew-' || CAST(o_orderkey AS STRING), CAST(NULL AS STRING), 'craftDB.xml',
  CAST(o_orderkey AS INT), 1, CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
FROM orders
UNION ALL
SELECT 'spell', 'spell:' || CAST(s_suppkey AS STRING), s_name, 's-' || CAST(s_suppkey AS STRING), 'cast by many', 'base',
  CAST(NULL AS STRING), CAST(NULL AS BIGINT), 'old-spell-' || CAST(s_suppkey AS STRING), 'stat ' || CAST(s_suppkey % 30 AS STRING),
  'spellDB.xml', CAST(s_suppkey AS INT), 1, CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
FROM supplier
UNION ALL
SELECT 'monster', 'monster:' || CAST(c_custkey AS STRING), c_name, 'm-' || CAST(c_custkey AS STRING), 'lurks', 'base',
  lower(c_mktsegment), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), 'monDB.xml', CAST(c_custkey AS INT), 1,
  CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
FROM customer
UNION ALL
SELECT 'stat', 'stat:' || CAST(n_nationkey AS STRING), n_name, 'n-' || CAST(n_nationkey AS STRING), '', 'reference',
  'group ' || CAST(n_regionkey AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), 'statDB.xml',
  CAST(n_nationkey AS INT), 1, CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
FROM nation
UNION ALL
SELECT 'template', 'template:' || CAST(r_regionkey AS STRING), r_name, 't-' || CAST(r_regionkey AS STRING), '', 'base',
  CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), 'manTemplateDB.xml',
  CAST(r_regionkey AS INT), 1, CAST(0 AS BIGINT), CAST(NULL AS BIGINT)
FROM region"""

VIEWS["sources_v"] = """
SELECT DISTINCT p_brand AS id, 'Brand pack ' || p_brand AS label,
  CASE length(p_brand) % 2 WHEN 0 THEN 'mod' ELSE 'expansion' END AS kind, CAST(length(p_brand) * 10 AS INT) AS precedence,
  'v' || CAST(length(p_brand) AS STRING) AS version
FROM part WHERE p_brand <> 'Brand#7'"""

VIEWS["modifiers_v"] = """
SELECT l_orderkey AS owner_no, 'item:' || CAST(l_orderkey AS STRING) AS owner_id,
  CASE WHEN l_returnflag = 'A' THEN 'damage' WHEN l_returnflag = 'N' THEN 'resistance'
    WHEN l_linestatus = 'F' THEN 'primary' ELSE 'secondary' END AS modifier_kind,
  CAST(l_linenumber AS STRING) AS source_key, l_quantity AS amount,
  CAST(l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS BIGINT) AS position,
  CASE WHEN l_linenumber <= 2 THEN 'item' WHEN l_linenumber <= 4 THEN 'ability' ELSE 'spell' END AS owner_kind
FROM lineitem"""

VIEWS["stats_v"] = """
SELECT 'stat' AS kind, 'stat:' || lower(n_name) AS id, lower(n_name) AS canonical_key, n_name AS name,
  CASE WHEN n_nationkey < 20 THEN CASE n_nationkey % 4 WHEN 0 THEN 'damage' WHEN 1 THEN 'resistance' WHEN 2 THEN 'primary'
    ELSE 'secondary' END END AS modifier_kind,
  CASE WHEN n_nationkey < 20 THEN CAST(CASE WHEN n_nationkey < 16 THEN CAST(floor(n_nationkey / 4.0) AS INT) + 1 ELSE 2 END AS STRING)
    END AS source_key
FROM nation"""

VIEWS["lines_v"] = """
SELECT l_orderkey AS recipe_no, l_partkey AS part_no, CAST(l_quantity AS BIGINT) AS amount, CAST(l_linenumber AS BIGINT) AS skill_level,
  l_suppkey AS supp_no, l_linenumber AS line_no
FROM lineitem"""

VIEWS["recipes_v"] = """
SELECT o_orderkey AS recipe_no, 'recipe:' || CAST(o_orderkey AS STRING) AS id, 'recipe ' || CAST(o_orderkey AS STRING) AS canonical_key,
  'Brew ' || CAST(o_custkey AS STRING) AS name, o_orderpriority AS tool, o_orderstatus = 'P' AS hidden,
  o_custkey AS output_no, 1 + o_orderkey % 3 AS output_amount, o_orderkey % 6 AS skill_level
FROM orders"""

VIEWS["bom_v"] = """
SELECT p_partkey AS parent, CAST(floor(p_partkey / 2.0) AS BIGINT) AS child, 1 + p_partkey % 3 AS per_craft, 0 AS place
FROM part WHERE p_partkey >= 2
UNION ALL
SELECT p_partkey, CAST(floor(p_partkey / 3.0) AS BIGINT), 1, 1 FROM part WHERE p_partkey >= 3"""

VIEWS["parents_v"] = """
SELECT p_partkey AS part_no, lower(p_name) || ' ' || CAST(p_partkey AS STRING) AS label,
  CASE WHEN p_partkey = 0 THEN CAST(NULL AS BIGINT) WHEN p_partkey = 5 THEN 21 WHEN p_partkey = 7 THEN 7
    WHEN p_partkey % 97 = 96 THEN 900000000 + p_partkey ELSE CAST(floor(p_partkey / 4.0) AS BIGINT) END AS parent_no,
  CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN '' ELSE CAST(NULL AS STRING) END AS description,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS INT) END AS depth,
  CASE WHEN p_partkey % 7 < 2 THEN 'icon' || CAST(p_partkey AS STRING) END AS icon,
  p_brand AS source_id, CAST(p_partkey % 4 AS STRING) AS mod_key, CAST(p_size AS DOUBLE) AS mod_amount
FROM part"""

VIEWS["drafts_v"] = """
SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, event_type AS code,
  'Saw ' || event_type || ' of ' || CAST(user_id % 20 AS STRING) AS message,
  'src' || CAST(user_id % 3 AS STRING) AS source_id, 'eventDB.xml' AS file, CAST(user_id % 10 + 1 AS INT) AS line, 1 AS col,
  'monster:' || CAST(user_id % 20 AS STRING) AS entity_id, user_id % 4 AS detail
FROM events"""

VIEWS["levels_v"] = """
SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 7 AS INT) AS fighter, CAST(c_nationkey % 5 AS INT) AS rogue,
  CAST(c_custkey % 3 AS INT) AS wizard, CAST(c_custkey % 11 AS DOUBLE) AS a1, CAST(c_nationkey AS DOUBLE) AS a2
FROM customer"""

VIEWS["spellbook_v"] = """
SELECT o_orderkey AS spell_no, 'spell:' || CAST(o_orderkey AS STRING) AS id, 'spell ' || CAST(o_orderkey AS STRING) AS canonical_key,
  CAST(floor(o_orderkey / 2.0) AS BIGINT) AS half, CAST(floor(o_orderkey / 3.0) AS BIGINT) AS third,
  CAST(floor(o_orderkey / 5.0) AS BIGINT) AS fifth, CAST(floor(o_orderkey / 7.0) AS BIGINT) AS seventh,
  o_custkey AS cust, o_orderkey % 2 = 0 AS has_buff, o_orderkey % 4 AS quarter
FROM orders"""
