import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from vellum.sources import trees

FILES = "source_id string, file string, kind string, precedence int, content string"


def random_tree(rng, depth, wide):
    """Text of a random tree, whose names tell elements apart."""
    count = iter(range(10**9))

    def grow(left):
        tag, n = rng.choice(["item", "group", "x"]), next(count)
        named = f' name="n{n}"' if rng.random() < 0.6 else ""
        inner = "".join(grow(left - 1) for _ in range(rng.randint(0, wide) if left else 0))
        return f"<{tag}{named}>t{n}{inner}</{tag}>"

    return "<db>" + "".join(grow(depth) for _ in range(wide)) + "</db>"


def walked(text):
    """(label, parent, depth, last, tag, name, text) by a plain walk."""
    rows, count = [], iter(range(10**9))

    def visit(element, parent, depth):
        own, at = next(count), len(rows)
        rows.append(None)
        for child in element:
            visit(child, own, depth + 1)
        said = (element.text or "").strip() + "".join((c.tail or "") for c in element).strip()
        rows[at] = (own, parent, depth, own + sum(1 for _ in element.iter()) - 1, element.tag, element.get("name"), said or None)

    visit(ET.fromstring(text), None, 0)
    return rows


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    texts = {f"{k}.xml": random_tree(rng, 9, 3) for k in range(4)}
    texts["deep.xml"] = "".join(f"<n{k} v='{k}'>" for k in range(900)) + "".join(f"</n{k}>" for k in reversed(range(900)))
    texts["wide.xml"] = "<db>" + "<item><x/></item>" * 2000 + "</db>"
    rows = [("base", f, "items", 0, t) for f, t in texts.items()] + [("base", "bad.xml", "items", 0, "<a>"), ("base", "none.xml", "items", 0, None)]
    nodes = trees.parse_nodes(spark.createDataFrame(rows, FILES)).cache()
    return {f: walked(t) for f, t in texts.items()}, nodes


def test_every_node_is_kept(sample):
    plain, nodes = sample
    for file, expected in plain.items():
        got = nodes.filter(F.col("file") == file).select("node", "parent", "depth", "last", "tag", F.col("attrs")["name"], "text").orderBy("node").collect()
        assert [tuple(r) for r in got] == expected, file
    assert {r.file: r.problem for r in nodes.filter("problem is not null").collect()} == {"bad.xml": "invalid_xml", "none.xml": "invalid_xml"}
    assert nodes.filter("file = 'deep.xml'").agg(F.max("depth")).first()[0] == 899


def test_descendants_and_nearest(sample):
    plain, nodes = sample
    groups = trees.elements(nodes, "group", "db")
    got = {(r.file, r.node, r.ancestor, r.levels) for r in trees.descendants(nodes, groups).collect()}
    assert got == {(f, b[0], a[0], b[2] - a[2]) for f, rows in plain.items() for a in rows if a[4] in ("group", "db") for b in rows if a[0] < b[0] <= a[3]}
    items = trees.elements(nodes, "item")
    near = {(r.file, r.node): r.holder for r in trees.with_nearest(items, items, "name", "holder").collect()}
    for f, rows in plain.items():
        for b in rows:
            if b[4] == "item":
                named = [a for a in rows if a[4] == "item" and a[5] and a[0] < b[0] <= a[3]]
                assert near[f, b[0]] == (max(named, key=lambda a: a[2])[5] if named else None)


def test_paths_and_unknown_elements(sample):
    plain, nodes = sample
    paths = {(r.file, r.node): r.path for r in trees.path(nodes, trees.elements(nodes, "x", "n899")).collect()}
    strange = {(r.file, r.parent, r.tag): (r.node, r.times) for r in trees.unknown_elements(nodes, {"item": ["x"], "group": []}).collect()}
    expected = {}
    for f, rows in plain.items():
        tags = {r[0]: r for r in rows}
        for r in rows:
            if r[4] in ("x", "n899"):
                way, at = [r[4]], r[1]
                while at is not None:
                    way.append(tags[at][4])
                    at = tags[at][1]
                assert paths[f, r[0]] == "/".join(reversed(way))
            allowed = {"item": ["x"], "group": []}.get(tags[r[1]][4]) if r[1] is not None else None
            if allowed is not None and r[4] not in allowed:
                first, n = expected.get((f, r[1], r[4]), (r[0], 0))
                expected[f, r[1], r[4]] = (first, n + 1)
    assert strange == expected


def joins(df):
    """Kinds of the joins that Spark plans, largest guesses allowed to be sent through the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


def test_nodes_never_meet_through_the_driver(spark):
    """Nodes look as small as their files to the planner; they are never broadcast for that."""
    files = spark.createDataFrame([("base", "a.xml", "items", 0, "<db><item name='n'><x/></item></db>")], FILES)
    nodes = trees.parse_nodes(files)
    items = trees.elements(nodes, "item")
    assert joins(trees.descendants(nodes, items)) == (1, 0)
    assert joins(trees.with_nearest(items, items, "name", "holder")) == (2, 0)
    assert joins(trees.path(nodes, items)) == (2, 0)


def test_only_the_rules_of_unknown_elements_are_broadcast(spark):
    files = spark.createDataFrame([("base", "a.xml", "items", 0, "<db><item name='n'><x/></item></db>")], FILES)
    assert joins(trees.unknown_elements(trees.parse_nodes(files), {"item": []})) == (1, 1)
