"""F and P rows: scalar functions and predicates over table-derived texts."""

from pyspark.sql import functions as F

from ..functions import keys, labels, lexemes
from ..functions.records import element
from ..operators import catalogue

from . import views  # noqa: F401
from .registry import query, source, table

TEXT = "SELECT row_id, {expr} AS value FROM texts_v"


def _texts(spark, sf):
    return source(spark, sf, "texts_v")


def _value(expr):
    return lambda spark, sf: _texts(spark, sf).select("row_id", expr().alias("value"))


SQL_KEY = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
SQL_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SQL_HEX = "array_to_string(list_transform(string_split({0}, ''), lambda c: lower(to_base(ord(c), 16))), '-')"
SQL_FNV = ("lower(to_base(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({0}, ''), "
           "lambda c: ord(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)::BIGINT, 36, 7))")
SQL_INT = ("CASE WHEN regexp_full_match({0}, '-?[0-9]+') AND abs(TRY_CAST({0} AS HUGEINT)) <= 9007199254740991 "
           "THEN CAST(TRY_CAST({0} AS HUGEINT) AS BIGINT) END")
SQL_NUM = "CASE WHEN regexp_full_match({0}, '-?([0-9]+(\\.[0-9]+)?|\\.[0-9]+)') THEN TRY_CAST({0} AS DOUBLE) END"
SQL_TITLE = ("array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '{1}'), lambda w: w <> ''), "
             "lambda w: upper(w[1:1]) || w[2:]), ' ')")

query("F01_canonical_key", TEXT.format(expr=SQL_KEY.format("label_text")))(_value(lambda: keys.canonical_key(F.col("label_text"))))
query("F02_slugify", f"SELECT row_id, CASE WHEN {SQL_SLUG.format('label_text')} <> '' THEN {SQL_SLUG.format('label_text')} "
      f"ELSE {SQL_HEX.format('label_text')} END AS value FROM texts_v")(_value(lambda: keys.slugify(F.col("label_text"))))
query("F03_entity_id", TEXT.format(expr="'item:' || " + SQL_KEY.format("label_text")))(
    _value(lambda: keys.entity_id("item", F.col("label_text"))))
query("F04_stable_suffix", TEXT.format(expr=SQL_FNV.format("label_text")))(_value(lambda: keys.stable_suffix(F.col("label_text"))))


@query("F05_code_unit_order", "SELECT p_brand, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY p_brand")
def code_unit_order(spark, sf):
    order = keys.code_unit_order(F.col("p_name"))
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.min_by("p_name", order).alias("first_name"), F.max_by("p_name", order).alias("last_name"))


N = "number_text"
query("F06_source_integer", TEXT.format(expr=SQL_INT.format(N)))(_value(lambda: lexemes.source_integer(F.col(N))))
query("F07_source_number", TEXT.format(expr=SQL_NUM.format(N)))(_value(lambda: lexemes.source_number(F.col(N))))


@query("F08_integer_value", f"""
SELECT row_id, coalesce(CASE WHEN {SQL_INT.format(N)} >= 0 THEN {SQL_INT.format(N)} END, 3) AS required,
  CASE WHEN {SQL_INT.format(N)} BETWEEN -50 AND 50 THEN {SQL_INT.format(N)} END AS optional,
  coalesce({N} <> '' AND CASE WHEN {SQL_INT.format(N)} >= 0 THEN 1 END IS NULL, FALSE) AS rejected FROM texts_v""")
def integer_value(spark, sf):
    text = F.col(N)
    return _texts(spark, sf).select(
        "row_id", lexemes.integer_or(text, 3, low=0).alias("required"), lexemes.optional_integer(text, -50, 50).alias("optional"),
        lexemes.integer_rejected(text, low=0).alias("rejected"))


@query("F09_number_value", f"""
SELECT row_id, coalesce({SQL_NUM.format(N)}, 1.5) AS required, CASE WHEN {SQL_NUM.format(N)} BETWEEN 0 AND 1 THEN {SQL_NUM.format(N)} END AS optional,
  coalesce({N} <> '' AND {SQL_NUM.format(N)} IS NULL, FALSE) AS rejected FROM texts_v""")
def number_value(spark, sf):
    text = F.col(N)
    return _texts(spark, sf).select(
        "row_id", lexemes.number_or(text, 1.5).alias("required"), lexemes.optional_number(text, 0, 1).alias("optional"),
        lexemes.number_rejected(text).alias("rejected"))


B = "flag_text"


@query("F10_boolean_attribute", f"""SELECT row_id, coalesce({B} IN ('1', 'true'), FALSE) AS value,
  coalesce({B} NOT IN ('0', '1', 'true', 'false'), FALSE) AS rejected FROM texts_v""")
def boolean_attribute(spark, sf):
    return _texts(spark, sf).select("row_id", lexemes.flag(F.col(B)).alias("value"), F.coalesce(lexemes.flag_rejected(F.col(B)), F.lit(False)).alias("rejected"))


query("F11_optional_boolean", TEXT.format(expr=f"CASE WHEN {B} IN ('1','true') THEN TRUE WHEN {B} IN ('0','false') THEN FALSE END"))(
    _value(lambda: lexemes.optional_flag(F.col(B))))
query("F12_binary_boolean", TEXT.format(expr=f"CASE {B} WHEN '1' THEN TRUE WHEN '0' THEN FALSE END"))(
    _value(lambda: lexemes.optional_bit(F.col(B))))


def _shaped_items(spark, sf):
    """Item records whose shape follows from the part's numbers."""
    p = table(spark, sf, "part")
    kid = lambda name, **a: element(name, a, depth=4)
    shape = F.col("p_partkey") % 14
    level = F.col("p_size").cast("string")
    slots = F.get(F.array(*[F.lit(s) for s in ("head", "ring", "neck", "tail")]), (F.col("p_size") % 4))
    inner = F.get(F.array(
        kid("weapon", hit=level), kid("armour", type=slots, level=level), kid("armour", type=F.lit("head"), level=level),
        kid("food", hp=level), kid("food", mp=level), kid("food", meat=F.lit("1")), kid("trap", level=level),
        kid("wand", mincharge=level), kid("potion", spell=F.lit("x")), kid("mushroom"), kid("gem"), kid("toolkit", tag=F.lit("still")),
        kid("price", amount=level), kid("price", amount=level)), shape.cast("int"))
    attrs = {
        "name": F.col("p_name"), "type": F.when(shape == 0, (F.col("p_size") % 11).cast("string")).when(shape == 13, F.lower("p_type")),
        "level": F.when(shape == 0, level), "overrideClassName": F.when(shape == 2, F.lit(" Orb ")),
        "alchemical": F.when(shape == 12, F.lit("1")),
    }
    record = element("item", attrs).withField("children", F.array(inner))
    return p.select("p_partkey", "p_type", "p_size", record.alias("record"))


SQL_SHAPE = """CASE p_partkey % 14
  WHEN 0 THEN coalesce(['weapon:sword','weapon:axe','weapon:mace','weapon:staff','weapon:crossbow','weapon:thrown',
    'weapon:ammunition','weapon:dagger','weapon:polearm'][p_size % 11 + 1], 'weapon')
  WHEN 1 THEN ['armour:head','armour:ring','armour:neck','armour'][p_size % 4 + 1] WHEN 2 THEN 'orb' WHEN 3 THEN 'food'
  WHEN 4 THEN 'booze' WHEN 5 THEN 'food' WHEN 6 THEN 'trap' WHEN 7 THEN 'wand' WHEN 8 THEN 'potion' WHEN 9 THEN 'mushroom'
  WHEN 10 THEN 'gem' WHEN 11 THEN 'toolkit' WHEN 12 THEN 'reagent' ELSE lower(p_type) END"""


@query("F13_item_category", f"SELECT p_partkey, {SQL_SHAPE} AS category FROM part")
def item_category(spark, sf):
    return _shaped_items(spark, sf).select("p_partkey", labels.item_category(F.col("record")).alias("category"))


@query("F14_item_quality", "SELECT p_partkey, CASE WHEN p_partkey % 14 IN (0, 1, 2, 6) THEN CAST(p_size AS BIGINT) ELSE 0 END AS quality FROM part")
def item_quality(spark, sf):
    return _shaped_items(spark, sf).select("p_partkey", labels.item_quality(F.col("record")).alias("quality"))


@query("F15_category_label", f"""
SELECT p_partkey, CASE c WHEN 'weapon:sword' THEN 'Sword weapon' WHEN 'weapon:axe' THEN 'Axe weapon' WHEN 'weapon:mace' THEN 'Mace weapon'
  WHEN 'weapon:staff' THEN 'Staff weapon' WHEN 'weapon:crossbow' THEN 'Crossbow' WHEN 'weapon:thrown' THEN 'Thrown weapon'
  WHEN 'weapon:ammunition' THEN 'Ammunition' WHEN 'weapon:dagger' THEN 'Dagger weapon' WHEN 'weapon:polearm' THEN 'Polearm weapon'
  WHEN 'armour:head' THEN 'Head armour' WHEN 'armour:ring' THEN 'Ring' WHEN 'armour:neck' THEN 'Amulet'
  ELSE upper(c[1:1]) || c[2:] END AS label
FROM (SELECT p_partkey, {SQL_SHAPE} AS c FROM part)""")
def category_label(spark, sf):
    shaped = _shaped_items(spark, sf).select("p_partkey", labels.item_category(F.col("record")).alias("c"))
    return shaped.select("p_partkey", labels.item_category_label(F.col("c")).alias("label"))


query("F16_title_case", f"SELECT row_id, {SQL_TITLE.format('label_text', '[-_: ]+')} AS category_title, "
      f"{SQL_TITLE.format('label_text', '[ _-]+')} AS display_title FROM texts_v")(
    lambda spark, sf: _texts(spark, sf).select(
        "row_id", labels.category_title(F.col("label_text")).alias("category_title"), labels.display_title(F.col("label_text")).alias("display_title")))

CODE = "CASE WHEN row_id % 3 = 0 THEN 'invalid_xml_root' ELSE lower(replace(word, '-', '_')) || '_xml' END"
query("F17_diagnostic_label", f"SELECT row_id, replace(replace({SQL_TITLE.format(CODE, '[ _-]+')}, 'Xml', 'XML'), 'NOT', 'NOT') AS value FROM texts_v")(
    lambda spark, sf: _texts(spark, sf).select("row_id", labels.diagnostic_label(F.expr(CODE)).alias("value")))

KEY = "CASE row_id % 3 WHEN 0 THEN 'NoFood' WHEN 1 THEN 'canOpenDoors' ELSE 'big_' || lower(status) || 'Flag' END"
query("F18_flag_label", f"""SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'No food' WHEN 1 THEN 'Can Open Doors' ELSE 'Big ' || upper(status) || ' Flag' END AS label,
  CASE row_id % 2 WHEN 1 THEN 'Enabled' ELSE CASE WHEN row_id % 4 = 0 THEN 'Disabled' ELSE 'x' END END AS flag_value FROM texts_v""")(
    lambda spark, sf: _texts(spark, sf).select(
        "row_id", labels.flag_label(F.expr(KEY)).alias("label"),
        labels.flag_value(F.expr("CASE WHEN row_id % 2 = 1 THEN '1' WHEN row_id % 4 = 0 THEN '0' ELSE 'x' END")).alias("flag_value")))


@query("F19_source_marker", """SELECT id, CASE WHEN kind = 'mod' THEN 'Mod' ELSE 'BPB' || substr(regexp_extract(id, '[0-9]+'), 1, 1) END AS marker FROM sources_v""")
def source_marker(spark, sf):
    return source(spark, sf, "sources_v").select("id", labels.source_marker(F.col("id"), F.col("kind"), F.col("label")).alias("marker"))


@query("F20_stat_search_key", "SELECT DISTINCT 'modifier:' || modifier_kind || ':' || source_key AS stat_key FROM modifiers_v")
def stat_search_key(spark, sf):
    return source(spark, sf, "modifiers_v").select(labels.stat_search_key(F.col("modifier_kind"), F.col("source_key")).alias("stat_key")).distinct()


@query("F21_modifier_label", """
SELECT m.owner_no, m.position, coalesce(s.name, CASE m.modifier_kind WHEN 'damage' THEN m.source_key || ' damage'
  WHEN 'resistance' THEN m.source_key || ' resistance' WHEN 'primary' THEN 'Primary attribute ' || m.source_key
  ELSE 'Secondary stat ' || m.source_key END) AS label,
  CASE WHEN m.amount > 0 THEN '+' ELSE '' END || CAST(CAST(m.amount AS BIGINT) AS VARCHAR) AS shown
FROM modifiers_v m LEFT JOIN (SELECT modifier_kind, source_key, min(name) AS name FROM stats_v WHERE modifier_kind IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) = 1) s USING (modifier_kind, source_key)""")
def modifier_label(spark, sf):
    from ..operators.linking import link_modifiers, selector_table

    stats = source(spark, sf, "stats_v")
    linked = link_modifiers(source(spark, sf, "modifiers_v"), selector_table(stats))
    named = linked.join(stats.select(F.col("id").alias("stat_id"), "name"), "stat_id", "left")
    return named.select(
        "owner_no", "position", labels.modifier_label(F.col("modifier_kind"), F.col("source_key"), F.col("name")).alias("label"),
        labels.signed_value(F.col("amount")).alias("shown"))


TRIGGERS = ["stepped-on", "zapped", "quaffed", "kill-target", "trigger-list", "nothing"]
TRIGGER_TEXT = {"stepped-on": "When stepped on", "zapped": "When zapped", "quaffed": "When quaffed",
                "kill-target": "When you kill an enemy", "trigger-list": "Triggered from a list"}
query("F22_trigger_label", "SELECT row_id, CASE row_id % 6 " + " ".join(
    f"WHEN {i} THEN '{TRIGGER_TEXT[k]}'" for i, k in enumerate(TRIGGERS) if k in TRIGGER_TEXT) + " END AS value FROM texts_v")(
    lambda spark, sf: _texts(spark, sf).select("row_id", labels.trigger_label(
        F.get(F.array(*[F.lit(k) for k in TRIGGERS]), (F.col("row_id") % 6).cast("int"))).alias("value")))

query("F23_normalize_query", f"SELECT row_id, {SQL_KEY.format('label_text')} AS query_text, "
      + SQL_KEY.format("regexp_replace(label_text, '[-_]+', ' ', 'g')") + " AS alias_text FROM texts_v")(
    lambda spark, sf: _texts(spark, sf).select(
        "row_id", keys.normalize_query(F.col("label_text")).alias("query_text"), keys.normalize_alias(F.col("label_text")).alias("alias_text")))
query("F24_edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS INT) AS edits FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("edits")))
query("F25_distance_limit", "SELECT row_id, CAST(greatest(1, least(5, floor(length(label_text) * 0.25))) AS INT) AS value FROM texts_v")(
    _value(lambda: lexemes.distance_limit(F.length("label_text"))))
query("F26_one_in_to_percent", "SELECT row_id, CASE WHEN number > 0 THEN CAST(floor(100.0 / number + 0.5) AS BIGINT) END AS value FROM texts_v")(
    _value(lambda: lexemes.one_in_to_percent(F.col("number"))))

PATH = """CASE row_id % 6 WHEN 0 THEN './items/' || word || '.png' WHEN 1 THEN 'items\\{bs}' || word WHEN 2 THEN '/etc/' || word
  WHEN 3 THEN 'C:' || word WHEN 4 THEN 'a/../' || word ELSE '' END"""
SPARK_PATH, DUCK_PATH = PATH.replace("{bs}", "\\"), PATH.replace("\\{bs}", "\\")
SQL_ASSET = """SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'items/' || word || '.png' WHEN 1 THEN 'items/' || word END AS {name}, row_id % 6 IN (2, 3, 4) AS unsafe FROM texts_v"""


def _asset(name):
    return lambda spark, sf: _texts(spark, sf).withColumn("path", F.expr(SPARK_PATH)).select(
        "row_id", labels.asset_path(F.col("path")).alias(name), labels.asset_path_unsafe(F.col("path")).alias("unsafe"))


query("F27_asset_path", SQL_ASSET.format(name="path"))(_asset("path"))
query("F40_asset_reference", SQL_ASSET.format(name="reference"))(_asset("reference"))


@query("F28_monster_icon_path", """SELECT row_id, row_id % 3 = 0 AS is_wrapper, row_id % 3 = 1 AS is_palette FROM texts_v""")
def monster_icon_path(spark, sf):
    path = F.expr("'art/' || word || CASE row_id % 3 WHEN 0 THEN '.XML' WHEN 1 THEN '.Pal' ELSE '.png' END")
    return _texts(spark, sf).select("row_id", labels.is_sprite_wrapper(path).alias("is_wrapper"), labels.palette_is_file(path).alias("is_palette"))


GRID = """array('..@', CASE WHEN row_id % 2 = 0 THEN '@#.' ELSE '@@.' END, CASE WHEN row_id % 5 = 0 THEN '@' ELSE '@@@' END)"""


@query("F29_template_summary", """SELECT row_id, 3 AS row_count, 3 AS column_count,
  CAST(1 + CASE WHEN row_id % 2 = 0 THEN 1 + CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END ELSE 2 END + CASE WHEN row_id % 5 = 0 THEN 1 ELSE 3 END AS INT) AS affected_tiles FROM texts_v""")
def template_summary(spark, sf):
    rows = _texts(spark, sf).withColumn("rows", F.expr(GRID))
    return rows.select("row_id", labels.rows_summary(F.col("rows"), F.expr("row_id % 3 = 0")).alias("s")).select("row_id", "s.*")


query("F30_template_valid", "SELECT row_id, row_id % 2 = 0 AND row_id % 5 <> 0 AS value FROM texts_v")(
    lambda spark, sf: _texts(spark, sf).select("row_id", labels.rows_valid(F.expr(GRID)).alias("value")))


@query("F31_monster_drop", """SELECT row_id, number % 150 <= 100 AND row_id % 3 <> 2 AS value FROM texts_v""")
def monster_drop(spark, sf):
    typed = F.expr("CASE WHEN row_id % 3 IN (0, 2) THEN 'gem' END")
    item = F.expr("CASE WHEN row_id % 3 IN (1, 2) THEN 'ruby' END")
    return _texts(spark, sf).select("row_id", labels.drop_valid(F.expr("number % 150"), typed, item, item, F.lit(None).cast("string")).alias("value"))


@query("F32_template_cells", """
SELECT row_id, r AS row_no, CAST(c AS INT) AS column_no, rows[r + 1][c + 1] AS cell
FROM (SELECT row_id, ['..@', CASE WHEN row_id % 2 = 0 THEN '@#.' ELSE '@@.' END, CASE WHEN row_id % 5 = 0 THEN '@' ELSE '@@@' END] AS rows FROM texts_v),
  (SELECT CAST(range AS INT) AS r FROM range(3)), (SELECT CAST(range AS INT) AS c FROM range(3)) WHERE c < length(rows[r + 1])""")
def template_cells(spark, sf):
    cells = catalogue.template_cells(_texts(spark, sf).select(F.col("row_id").alias("id"), F.expr(GRID).alias("rows")))
    return cells.select(F.col("template_id").alias("row_id"), F.col("row").alias("row_no"), F.col("column").alias("column_no"), F.col("mark").alias("cell"))


query("F33_lowest_level", "SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 9007199254740991 ELSE least(number, row_id % 9) END AS value FROM texts_v")(
    _value(lambda: labels.lowest_level(F.expr("CASE WHEN row_id % 4 = 0 THEN cast(array() AS array<bigint>) ELSE array(number, row_id % 9) END"))))
query("F34_charge_range", """SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'Unavailable' WHEN 1 THEN CAST(number AS VARCHAR)
  WHEN 2 THEN '?–' || CAST(number AS VARCHAR) ELSE CAST(number AS VARCHAR) || '–' || CAST(number + 3 AS VARCHAR) END AS value FROM texts_v""")(
    _value(lambda: labels.charge_range(F.expr("CASE WHEN row_id % 4 IN (1, 3) THEN number END"),
                                       F.expr("CASE row_id % 4 WHEN 1 THEN number WHEN 2 THEN number WHEN 3 THEN number + 3 END"))))
query("F35_list_display", """SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'Not declared' WHEN 1 THEN word || ', Unavailable' ELSE word END AS listed,
  CASE row_id % 3 WHEN 0 THEN 'Yes, No' ELSE 'Unavailable' END AS flags FROM texts_v""")(
    lambda spark, sf: _texts(spark, sf).select(
        "row_id",
        labels.listed(F.expr("CASE row_id % 3 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array(word, NULL) ELSE array(word) END")).alias("listed"),
        labels.listed_flags(F.expr("CASE row_id % 3 WHEN 0 THEN array(true, false) ELSE array(cast(NULL AS boolean)) END")).alias("flags")))
query("F36_facet_label", """SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'Acid damage' WHEN 1 THEN 'Primary attribute ' || status || ':2'
  WHEN 2 THEN 'Modifier:odd:7' ELSE 'My Stat' END AS value FROM texts_v""")(
    _value(lambda: labels.facet_label(F.expr("CASE row_id % 4 WHEN 0 THEN 'modifier:damage:acid' WHEN 1 THEN 'modifier:primary:' || status || ':2' WHEN 2 THEN 'modifier:odd:7' ELSE 'my_stat' END"))))
query("F37_encounter_group", """SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'Special monster' WHEN row_id % 3 = 0 THEN 'Unknown dungeon depth'
  ELSE 'Dungeon level ' || CAST(number AS VARCHAR) END AS value FROM texts_v""")(
    _value(lambda: labels.encounter_group(F.expr("row_id % 5 = 0"), F.expr("CASE WHEN row_id % 3 <> 0 THEN number END"))))
query("F38_first_letter", "SELECT p_partkey, upper(p_name[1:1]) AS letter FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", labels.first_letter(F.col("p_name")).alias("letter")))
query("F39_requirement_numbers", f"""SELECT row_id, CASE WHEN {SQL_INT.format(N)} BETWEEN -128 AND 127 THEN {SQL_INT.format(N)} END AS signed_byte,
  CASE WHEN {SQL_INT.format(N)} >= 1 THEN {SQL_INT.format(N)} END AS positive, {SQL_NUM.format(N)} AS finite FROM texts_v""")(
    lambda spark, sf: _texts(spark, sf).select(
        "row_id", lexemes.signed_byte(F.col(N)).alias("signed_byte"), lexemes.positive_integer(F.col(N)).alias("positive"),
        lexemes.source_number(F.col(N)).alias("finite")))
