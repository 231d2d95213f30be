import pytest
from pyspark.sql import functions as F

from vellum import session
from vellum.operators import merge, ordering, patching, publish, routing, search
from vellum.sources import inputs, xml_records


def test_merge_keeps_history_in_any_input_order(spark):
    rows = [("item", "blade", 10, "mod", "m.xml", 3, 1, "Blade", None, 5), ("item", "blade", 0, "base", "a.xml", 9, 1, "Blade", "b1", 3),
            ("item", "blade", 10, "mod", "m.xml", 7, 1, "BLADE", None, 5), ("item", "gem", 0, "base", "a.xml", 1, 1, "Gem", None, 1)]
    schema = ("kind string, canonical_key string, precedence int, source_id string, file string, line int, column int, original_name string, "
              "original_id string, price int")
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, schema)
        best = {r.canonical_key: (r.line, r.variant_count) for r in merge.resolve(table, ["price"]).collect()}
        assert best == {"blade": (7, 3), "gem": (1, 1)}
        steps = merge.history(table, ["price"]).filter("canonical_key = 'blade'").orderBy("position").collect()
        assert [(s.position, s.provenance.line, s.changed_fields) for s in steps] == [(1, 9, None), (2, 3, ["price"]), (3, 7, [])]


def test_two_names_with_one_slug_get_a_stable_suffix(spark):
    rows = [("item", "item:a b", "a b", "A b"), ("item", "item:a-b", "a-b", "A-B")]
    entities = spark.createDataFrame(rows, "kind string, id string, canonical_key string, name string")
    none = spark.createDataFrame([], "kind string, id string, canonical_slug string, aliases array<string>")
    shielded = spark.createDataFrame([], "kind string, slug string")
    got = {r.id: r.slug for r in routing.allocate_slugs(entities, none, shielded).collect()}
    assert got["item:a b"] == "a-b" and got["item:a-b"].startswith("a-b-") and len(got["item:a-b"]) == 11


def test_a_taken_suffix_is_retried(spark):
    rows = [("item", "item:a b", "a b", "A b"), ("item", "item:a-b", "a-b", "A-B")]
    entities = spark.createDataFrame(rows, "kind string, id string, canonical_key string, name string")
    none = spark.createDataFrame([], "kind string, id string, canonical_slug string, aliases array<string>")
    nobody = spark.createDataFrame([], "kind string, slug string")
    first = {r.id: r.slug for r in routing.allocate_slugs(entities, none, nobody).collect()}["item:a-b"]
    blocked = spark.createDataFrame([("item", first)], "kind string, slug string")
    second = {r.id: r.slug for r in routing.allocate_slugs(entities, none, blocked).collect()}["item:a-b"]
    assert second != first and second.startswith("a-b-")


def test_a_stale_precondition_leaves_the_whole_patch_unapplied(spark):
    entities = spark.createDataFrame([("item", "a", "item:a", "A", "base", {"price": "1"}), ("item", "b", "item:b", "B", "base", {"price": "2"})],
                                     "kind string, canonical_key string, id string, name string, source_id string, fields map<string,string>")
    ops = spark.createDataFrame([("p", 0, "item", "a", "price", "1", "9", "base"), ("p", 1, "item", "b", "price", "5", "9", "base")],
                                "patch_id string, op_index int, kind string, canonical_key string, field string, expected string, value string, patch_source string")
    after, report = patching.apply_patches(entities, ops, ["p"])
    assert {r.id: r.fields["price"] for r in after.collect()} == {"item:a": "1", "item:b": "2"}
    assert [r.issue for r in report.orderBy("op_index").collect()] == [None, "patch_precondition_failed"]


def test_suggestions_only_for_queries_without_results_and_within_filters(spark):
    rows = [("item:1", "item", "Iron Sword", "iron sword item base", []), ("spell:1", "spell", "Iron Ward", "iron ward spell base", ["old-ward"])]
    docs = spark.createDataFrame(rows, "id string, kind string, name string, text string, aliases array<string>").selectExpr(
        "*", "'base' AS source_id", "cast(NULL AS string) AS category", "cast(NULL AS bigint) AS skill_level", "cast(array() AS array<string>) AS stat_keys")
    asked = [search.SearchQuery("hit", "iron"), search.SearchQuery("typo", "iorn sword"), search.SearchQuery("kind", "iorn sword", kinds=["spell"]),
             search.SearchQuery("alias", "oldward"), search.SearchQuery("short", "xy")]
    got = {(r.query_id, r.name) for r in search.suggest(docs, asked).collect()}
    assert got == {("typo", "Iron Sword"), ("alias", "Iron Ward")}
    with pytest.raises(ValueError):
        search.SearchQuery("bad", max_skill=-1)


def test_numbering_matches_a_window_on_a_skewed_group(spark):
    df = spark.range(5000).select(F.expr("case when id % 10 = 0 then 'cold' else 'hot' end").alias("g"), F.expr("cast(id * 7919 % 5000 as int)").alias("v"))
    got = {(r.g, r.v): r.row_number for r in ordering.numbered(df, ["g"], ["v"]).collect()}
    for group in ("hot", "cold"):
        values = sorted(v for g, v in got if g == group)
        assert [got[(group, v)] for v in values] == list(range(1, len(values) + 1))


def test_reader_reports_positions_parents_and_faults(spark):
    good = '<monDB>\r\n  <!-- <monster name="x"/> -->\n  <monster name="Ａ">\n    <monster><monster name="leaf"/></monster>\n  </monster>\n</monDB>'
    rows = [("base", "a.xml", "monsters", 0, good), ("base", "b.xml", "monsters", 0, "<a><b></a>"), ("base", "c.xml", "monsters", 0, "<!doctype a><a/>")]
    files = spark.createDataFrame(rows, "source_id string, file string, kind string, precedence int, content string")
    parsed = xml_records.parse_xml(files).cache()
    found = [(r.record.attrs.get("name"), r.parent_name, r.line, r.column) for r in xml_records.records(parsed, "monster").orderBy("place").collect()]
    assert found == [("Ａ", None, 3, 3), (None, "Ａ", 4, 5), ("leaf", "Ａ", 4, 14)]
    folded = xml_records.records(parsed, "monster").orderBy("place").first().record.folded
    assert folded == {"name": "A"}
    assert {r.code for r in xml_records.problems(parsed).collect()} == {"invalid_xml", "disallowed_doctype"}


def test_publication_is_gated_and_verified(spark, tmp_path):
    table = spark.range(20).withColumn("name", F.col("id").cast("string"))
    errors = spark.createDataFrame([("error",)], "severity string")
    with pytest.raises(ValueError):
        publish.write_tables({"t": table}, f"{tmp_path}/blocked", errors)
    with pytest.raises(ValueError):
        publish.write_tables({"t": table}, f"{tmp_path}/src/out", source_roots=[f"{tmp_path}/src"])
    publish.write_tables({"t": table}, f"{tmp_path}/ok")
    assert publish.read_verified(spark, f"{tmp_path}/ok")["t"].count() == 20
    table.limit(1).write.mode("append").parquet(f"{tmp_path}/ok/t")
    with pytest.raises(ValueError):
        publish.read_verified(spark, f"{tmp_path}/ok")


def test_reference_stats_are_complete(spark):
    stats = inputs.reference_stats(spark)
    assert stats.count() == 62 and stats.select("modifier_kind", "source_key").distinct().count() == 62


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        applicationId, master = "elsewhere", "yarn"

        class _jsc:
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False
                        return Nothing
                return Scala

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        session.use_checkpoint_dir(Session)


def test_reader_keeps_texts_as_written(spark):
    nest = "".join(f"<n{k} v='{k}'>" for k in range(9)) + "".join(f"</n{k}>" for k in reversed(range(9)))
    rows = [("base", "a.xml", "items", 0, '<db><item name=" A &amp; B " level="\t5\n" note="R&D"/><item name="x"/></db>'), ("base", "b.xml", "items", 0, "  \n"),
            ("base", "c.xml", "items", 0, f"<db><item name='deep'>{nest}</item><item><item><item/></item></item></db>")]
    parsed = xml_records.parse_xml(spark.createDataFrame(rows, "source_id string, file string, kind string, precedence int, content string")).cache()
    got = xml_records.records(parsed, "item").filter("file = 'a.xml'").orderBy("place").collect()
    assert got[0].record.attrs == {"name": "A &amp; B", "level": "5", "note": "R&D"}
    assert [(r.line, r.column) for r in got] == [(1, 5), (2, 15)]
    problems = {(r.file, r.code, r.line) for r in xml_records.problems(parsed).collect()}
    assert problems == {("b.xml", "invalid_xml", 1)}
    assert xml_records.records(parsed, "item").filter("file = 'c.xml'").count() == 4


def test_numbering_by_code_units_and_whole_tables(spark):
    from vellum.functions.keys import code_unit_order

    df = spark.createDataFrame([("\U0001F600",), ("～",), ("a",)], "v string")
    assert {r.v: r.row_number for r in ordering.numbered(df, [], [code_unit_order(F.col("v"))], 2).collect()} == {"a": 1, "\U0001F600": 2, "～": 3}


def test_drafts_that_share_a_signature_get_different_ids(spark, monkeypatch):
    from vellum.operators import diagnostics

    monkeypatch.setattr(diagnostics, "draft_json", lambda details: F.lit("same"))
    rows = [("error", "c", m, "s", "f", 1, 1, None, {}) for m in ("one", "one", "two")]
    drafts = spark.createDataFrame(rows, "severity string, code string, message string, source_id string, file string, line int, column int, entity_id string, details map<string,string>")
    ids = sorted(r.id.split(":")[1][12:] for r in diagnostics.finalize(drafts).collect())
    assert ids == ["", "-2", "-3"]


def test_a_table_of_queries_answers_like_the_compiled_list(spark):
    from vellum.functions.keys import normalize_query

    docs = spark.range(400).selectExpr(
        "concat('d', id) AS id", "element_at(array('item', 'recipe', 'spell'), cast(id % 3 as int) + 1) AS kind",
        "concat(element_at(array('Iron Sword', 'Red Ring', 'Oak Ward', 'X'), cast(id % 4 as int) + 1), ' ', id % 9) AS name",
        "concat('s', id % 2) AS source_id", "concat('c', id % 5) AS category", "id % 7 AS skill_level", "array(concat('k', id % 3)) AS stat_keys")
    docs = docs.withColumn("text", normalize_query(F.concat_ws(" ", "name", "kind", "category", "source_id"))).cache()
    asked = [search.SearchQuery("a", "iron sw"), search.SearchQuery("b", "ring 3", limit=4), search.SearchQuery("c", ""), search.SearchQuery("d", "x"), search.SearchQuery("e", "zzz"),
             search.SearchQuery("f", "ward", kinds=["item", "spell"], source_ids=["s1"]), search.SearchQuery("g", "OAK", category="c2", max_skill=3), search.SearchQuery("h", "", stat_key="k1", limit=0)]
    rows = [(q.id, q.query, q.kinds, q.source_ids, q.category, q.stat_key, q.max_skill, q.limit) for q in asked]
    table = spark.createDataFrame(rows, "query_id string, query string, kinds array<string>, source_ids array<string>, category string, stat_key string, max_skill bigint, limit bigint")
    pick = lambda df: [tuple(r) for r in df.select("query_id", "id", "score").collect()]
    assert pick(search.search_table(docs, table)) == pick(search.search(docs, asked))


def test_template_cells_are_those_of_every_text(spark, tmp_path):
    import duckdb

    from vellum import bindings

    at = f"{tmp_path}/orders.parquet"
    spark.createDataFrame([(1,), (2,), (5,), (5,), (10,), (None,)], "o_orderkey long").selectExpr(
        "o_orderkey", "o_orderkey AS o_custkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus").write.parquet(at)
    df = bindings.QUERIES["F32_template_cells"](spark, str(tmp_path))
    rows = sorted(map(tuple, df.collect()), key=repr)
    grids = {1: ["..@", "@@.", "@@@"], 2: ["..@", "@#.", "@@@"], 5: ["..@", "@@.", "@"], 10: ["..@", "@#.", "@"], None: ["..@", "@@.", "@@@"]}
    assert df.columns == ["row_id", "row_no", "column_no", "cell"]
    assert rows == sorted(((k, y, x, mark) for k in (1, 2, 5, 5, 10, None) for y, line in enumerate(grids[k]) for x, mark in enumerate(line)), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{at}/*.parquet')")
    assert rows == sorted(con.execute(bindings.ORACLES["F32_template_cells"]).fetchall(), key=repr)


def test_template_cells_of_uneven_and_missing_rows(spark):
    from vellum.operators import catalogue

    templates = spark.createDataFrame([("a", ["#", "", "剣😀.", None]), ("b", []), ("c", None)], "id string, rows array<string>")
    assert sorted(map(tuple, catalogue.template_cells(templates).collect())) == [("a", 0, 0, "#"), ("a", 2, 0, "剣"), ("a", 2, 1, "😀"), ("a", 2, 2, ".")]
