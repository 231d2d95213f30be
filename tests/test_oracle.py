"""Every registered query with SQL next to it must agree with DuckDB.

By default a sample that touches each module runs on the smallest tables; set
``VELLUM_ALL=1`` for all of them (about ten minutes).
"""

import os

import pytest

from oracle_check import compare, duck
from vellum import bindings

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "F01_canonical_key", "F04_stable_suffix", "F13_item_category", "W01_winner", "W02_history", "W03_changed_fields", "W04_allocate_slugs",
    "W05_alias_conflicts", "W06_diagnostic_identity", "U01_apply_patches", "Q07_registry_issues", "J01_aliases_for", "J12_resolution_priority",
    "J41_used_to_craft", "U07_all_backlinks", "Q-S4_search", "Q-S5_suggestions", "Q-S6_scope_repair", "W08_browse_pages", "A04_item_categories",
    "R01_item_comparison", "I01_inheritance", "I07_demand", "A17_level_stats", "S03_parse_xml", "S05_nested_parents", "J20_icon_fallback",
    "K02_write_outputs", "N13_spell_triggers", "N17_recipes",
]
CHOSEN = [n for n in bindings.ORACLES if os.environ.get("VELLUM_ALL") or n in SAMPLE]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_agrees_with_sql(spark, con, name):
    state, _, _, note = compare(spark, con, name, bindings.QUERIES[name], bindings.ORACLES[name], SF_DIR)
    assert state == "ok", note


def test_sample_names_exist():
    assert not set(SAMPLE) - set(bindings.ORACLES)


def test_only_the_depth_first_walks_lack_sql():
    assert set(bindings.QUERIES) - set(bindings.ORACLES) == {"I03_effect_chain", "I06_cycle_report"}
