import random

import pytest

from vellum.operators import ordering, patching
from pyspark.sql import functions as F

OPS = "patch_id string, op_index bigint, kind string, canonical_key string, field string, expected string, value string, patch_source string"


def in_order(entities, patches):
    """Apply patches one after the other: (fields by key, applied ids by key, first failed guard by (patch, index))."""
    fields = {k: dict(f) for k, f in entities.items()}
    applied, issues = {k: [] for k in entities}, {}
    for patch_id, operations in patches:
        seen, found = set(), {}
        for index, (key, field, expected, value, source) in operations:
            if (key, field) in seen:
                found[index] = "patch_duplicate_operation"
                continue
            seen.add((key, field))
            if key not in fields:
                found[index] = "patch_target_missing"
            elif source != "base":
                found[index] = "patch_source_mismatch"
            elif field not in ("price", "quality"):
                found[index] = "patch_field_unsupported"
            elif not (expected.isdigit() and value.isdigit()):
                found[index] = "patch_value_invalid"
            elif expected == value:
                found[index] = "patch_noop"
            elif not fields[key].get(field, "null").isdigit():
                if not (field == "price" and fields[key].get(field, "null") == "null"):
                    found[index] = "patch_value_invalid"
                else:
                    found[index] = "patch_precondition_failed"
            elif fields[key][field] != expected:
                found[index] = "patch_precondition_failed"
        issues |= {(patch_id, i): c for i, c in found.items()}
        if not found:
            for _, (key, field, _, value, _) in operations:
                fields[key][field] = value
                if patch_id not in applied[key]:
                    applied[key].append(patch_id)
    return fields, applied, issues


def run(spark, entities, patches):
    rows = [("item", k, f"item:{k}", k.upper(), "base", f) for k, f in entities.items()]
    table = spark.createDataFrame(rows, "kind string, canonical_key string, id string, name string, source_id string, fields map<string,string>")
    operations = [(p, i, "item", key, field, e, v, s) for p, ops in patches for i, (key, field, e, v, s) in ops]
    after, judged = patching.apply_patches(table, spark.createDataFrame(operations, OPS), [p for p, _ in patches])
    after = after.collect()
    return ({r.canonical_key: dict(r.fields) for r in after}, {r.canonical_key: list(r.applied_patches) for r in after},
            {(r.patch_id, r.op_index): r.issue for r in judged.filter("issue is not null").collect()})


@pytest.mark.parametrize("seed", range(3))
def test_patches_at_once_equal_patches_in_order(spark, seed):
    rng = random.Random(seed)
    entities = {f"k{n}": {"price": str(rng.randrange(3)), "quality": "1"} if n else {"quality": "x"} for n in range(7)}
    patches = []
    for n in range(60):
        operations = [(i, (f"k{rng.randrange(8) if rng.random() < 0.1 else rng.randrange(1, 7)}", rng.choice(["price"] * 6 + ["quality", "slug"] * (rng.random() < 0.1)),
                           str(rng.randrange(3)), str(rng.randrange(3)), "base" if rng.random() < 0.97 else "other")) for i in range(rng.randint(1, 2))]
        patches.append((f"p{n:03d}", operations))
    assert run(spark, entities, patches) == in_order(entities, patches)


def test_long_chains_and_one_crowded_field(spark):
    """Each patch needs what the one before it wrote; one is broken, and what hangs on it falls with it."""
    entities = {"a": {"price": "0"}, "b": {"price": "0"}}
    patches = [(f"p{n:04d}", [(0, ("a", "price", str(n), str(n + 1), "base"))]) for n in range(400)]
    patches += [(f"q{n:04d}", [(0, ("b", "price", str(n), str(n + 1), "base")), (1, ("gone", "price", "400", "401", "base"))][: 2 if n == 150 else 1]) for n in range(156)]
    fields, applied, issues = run(spark, entities, patches)
    assert (fields, applied, issues) == in_order(entities, patches)
    assert fields == {"a": {"price": "400"}, "b": {"price": "150"}}


def test_values_are_carried_over_stretches(spark):
    rows = [(k % 3, k, k if k % 7 == 0 else None) for k in range(500)]
    df = ordering.in_stretches(spark.createDataFrame(rows, "g int, n int, v int"), ["g"], ["n"])
    got = {r.n: r.before for r in ordering.value_before(df, ["g"], ["n"], F.col("v"), "before").collect()}
    last = {}
    for g, n, v in rows:
        assert got[n] == last.get(g)
        if v is not None:
            last[g] = v


def test_drafts_of_patches(spark):
    entities = {"a": {"price": "1", "quality": "x"}}
    patches = [("good", [(0, ("a", "price", "1", "2", "base"))]), ("bad", [(0, ("a", "price", "1", "3", "base")), (1, ("b", "price", "1", "2", "base")), (2, ("a", "quality", "1", "2", "base"))])]
    rows = [("item", k, f"item:{k}", k.upper(), "base", f) for k, f in entities.items()]
    table = spark.createDataFrame(rows, "kind string, canonical_key string, id string, name string, source_id string, fields map<string,string>")
    operations = [(p, i, "item", key, field, e, v, s) for p, ops in patches for i, (key, field, e, v, s) in ops]
    _, judged = patching.apply_patches(table, spark.createDataFrame(operations, OPS), ["good", "bad"])
    files = spark.createDataFrame([(p, f"{p}.json", "base") for p in ("good", "bad")], "patch_id string, file string, source_id string")
    told = sorted((r.severity, r.code, r.message, r.entity_id, r.details) for r in patching.patch_drafts(judged, files).collect())
    assert told == [
        ("error", "patch_precondition_failed", "Patch bad expected a different current value for A.price.", "item:a", {"patchId": '"bad"', "operationIndex": "0", "expectedValue": "1", "actualValue": "2"}),
        ("error", "patch_target_missing", "Patch bad targets an unknown item: b.", None, {"patchId": '"bad"', "operationIndex": "1"}),
        ("error", "patch_value_invalid", "Active item.quality has an unsupported value type.", "item:a", {"patchId": '"bad"', "operationIndex": "2"}),
        ("info", "patch_applied", "Applied patch good to A.", "item:a", {"patchId": '"good"', "changedFields": '["price"]'}),
    ]
