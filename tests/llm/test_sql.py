"""Queries that SQL can express, against DuckDB on whole small tables."""

import pytest

from oracle_check import compare, duck

from vellum.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    state, n, _, note = compare(spark, duck(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert state == "ok" and n > 0 and not note, note
