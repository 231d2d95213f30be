"""Reading a parsed element: its attributes and the elements directly inside it.

A record column is ``struct<tag, attrs, folded, line, column, children>``;
``children`` nests the same struct for the ``RULE_LEVELS`` levels that the rules of
the normalisers look at; whole trees are rows of ``sources.trees``. ``folded`` has the compatibility
form of those attributes that are not ASCII: the reader of the text computes it,
so that keys inside nested records need no Python afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .keys import canonical_key

# Declarations inside a hook of a spell's buff are three levels down, and what stands inside those is reported as unknown: four.
RULE_LEVELS = 4


def element_type(depth: int = RULE_LEVELS) -> T.StructType:
    fields = [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("folded", T.MapType(T.StringType(), T.StringType())),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
    ]
    if depth:
        fields.append(T.StructField("children", T.ArrayType(element_type(depth - 1))))
    return T.StructType(fields)


def attribute(record: Column, name: str) -> Column:
    return record["attrs"][name]


def attribute_key(record: Column, *names: str) -> Column:
    """Canonical key of the first attribute that is not blank."""
    texts = [
        F.when(F.trim(record["attrs"][n]) != "", F.coalesce(record["folded"][n], record["attrs"][n])) for n in names
    ]
    return canonical_key(F.coalesce(*texts), ascii_text=True)


def any_attribute(record: Column, *names: str) -> Column:
    """The first of several accepted spellings of one attribute."""
    return F.coalesce(*[attribute(record, name) for name in names])


def named(record: Column, name: str) -> Column:
    """An attribute that counts as missing when it is empty."""
    text = attribute(record, name)
    return F.when(text != "", text)


def children(record: Column, *tags: str) -> Column:
    found = F.filter(record["children"], lambda c: c["tag"].isin(*tags))
    return F.coalesce(found, F.filter(record["children"], lambda c: F.lit(False)))


def children_any_case(record: Column, tag: str) -> Column:
    return F.filter(record["children"], lambda c: F.lower(c["tag"]) == tag.lower())


def has_child(record: Column, *tags: str) -> Column:
    return F.exists(record["children"], lambda c: c["tag"].isin(*tags))


def first_child(record: Column, tag: str) -> Column:
    return F.get(children(record, tag), 0)


def child_attribute(record: Column, tag: str, name: str) -> Column:
    return attribute(first_child(record, tag), name)


def element(tag: str, attrs: dict[str, Column], inner: list[Column] | None = None, depth: int = RULE_LEVELS,
            line: Column | None = None) -> Column:
    """Build a record column from other columns (used where records come from tables)."""
    pairs = [part for name, value in attrs.items() for part in (F.lit(name), value.cast("string"))]
    built = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map()
    parts = [
        F.lit(tag).alias("tag"),
        built.cast("map<string,string>").alias("attrs"),
        F.create_map().cast("map<string,string>").alias("folded"),
        (line if line is not None else F.lit(1)).cast("int").alias("line"),
        F.lit(1).cast("int").alias("column"),
    ]
    if depth:
        kids = F.array(*inner) if inner else F.array()
        parts.append(kids.cast(T.ArrayType(element_type(depth - 1))).alias("children"))
    return F.struct(*parts).cast(element_type(depth))
