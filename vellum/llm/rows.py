"""Row keys, and joins of per-row results back to rows.

A row is known by 128 bits: its integer id and a 64-bit hash of its text, which tells
the texts of one id apart. Equal rows share the key and therefore the result, which is
right for every operator here: what an operator decides depends on the text and the id
only. In place of a null id stands another hash of the text, from a band of numbers
below all usual ids (below -2**62), so that null ids are as far apart as others, come
first in order, and give classes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids below this are stand-ins for null.
NULL_BELOW = -(2**62)
KEY = ["row_id", "row_hash"]


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only (row_id, row_hash, id, text): extra columns of any name are left behind. A null text is empty."""
    row_id, row_hash = key_columns(id_column, text_column)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(row_id.alias("row_id"), row_hash.alias("row_hash"), F.col(id_column).cast("long").alias("id"), text.alias("text"))


def key_columns(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """The key of a row, to join a decision to rows that keep all their columns."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    stand_in = F.lit(2 * NULL_BELOW) + F.xxhash64(F.lit(1), text).bitwiseAND(-NULL_BELOW - 1)
    return [F.coalesce(F.col(id_column).cast("long"), stand_in), F.xxhash64(text)]


def real_id(row_id: str) -> Column:
    """The id that a key stands for: null for a stand-in."""
    return F.when(F.col(row_id) >= F.lit(NULL_BELOW), F.col(row_id))


def with_decision(docs: DataFrame, decision: DataFrame, column: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` as a struct ``row`` next to ``column`` of a table that has one row per key, null where it has none."""
    row_id, row_hash = key_columns(id_column, text_column)
    left = docs.select(row_id.alias("l_id"), row_hash.alias("l_hash"), F.struct("*").alias("row"))
    right = decision.select(*KEY, column)
    return left.join(right, (left.l_id == right.row_id) & (left.l_hash == right.row_hash), "left").select("row", column)


def text_bytes(docs: DataFrame, text_column: str = "text") -> int:
    """Bytes of all texts; it decides how many buckets a shuffle deals to."""
    return docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
