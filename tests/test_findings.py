"""Findings of spells: read once per record, by as many tasks as a shuffle has."""

import pytest
from pyspark.sql import functions as F

from vellum import bindings
from vellum.normalize import fields


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, k % 3, "O", f"{k % 5}-HIGH") for k in range(12)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(f"{sf}/orders.parquet")
    return sf


@pytest.mark.parametrize("name, expected", [
    ("N27_buff_findings", {"missing_spell_buff_payback_secondary_scale": 12, "missing_spell_buff_hook_target": 12, "invalid_number": 15, "invalid_boolean": 6,
                           "conflicting_spell_buff_halo_aliases": 4, "missing_spell_buff_polymorph_target": 3}),
    ("N36_effect_findings", {"missing_spell_effect_option_target": 12, "unknown_attribute": 12, "incomplete_spell_effect_buff_condition": 6, "invalid_number": 13,
                             "conflicting_spell_effect_item_target_aliases": 2}),
])
def test_records_are_read_once_in_many_tasks(spark, folder, name, expected):
    found = bindings.QUERIES[name](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform(" in line]
    assert {r.code: r.n for r in found.collect()} == expected


def test_absent_texts_and_bounds_of_checks(spark):
    texts = [None, "", " ", "5", "11", "x", "-1", "0.5"]
    whole = fields.Check(F.col("t"), F.lit("field"), fields.rule_text("integer", 0, 10, blank=True))
    low = fields.Check(F.col("t"), F.lit("low"), fields.rule_text("number", 0)).when(F.col("t") != "x")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fields.present([whole, low]).alias("f"))
    got = {r.t: [f.message.split(" for ")[1].split(";")[0] for f in r.f] for r in rows.collect()}
    assert got == {None: [], "": ["field"], " ": ["field", "low"], "5": [], "11": ["field"], "x": ["field"], "-1": ["field", "low"], "0.5": ["field"]}
