"""Identity keys, slugs and the order used for everything that is stored."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters a catalogue name treats as blank.
BLANK = r"[\t\n\u000B\f\r    -     　﻿]+"
NON_ASCII = r"[^\x00-\x7F]"

# The 32-bit FNV-1a offset and prime.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return normalise


@F.pandas_udf(T.StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    def strip(text: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", text) if unicodedata.category(ch)[0] != "M")

    return values.map(strip, na_action="ignore")


def _only_where_needed(text: Column, convert) -> Column:
    """ASCII text is already in every normal form, so Python sees nulls for it."""
    exotic = text.rlike(NON_ASCII)
    return F.when(exotic, convert(F.when(exotic, text))).otherwise(text)


def fold_text(text: str) -> str:
    """The canonical form of one text on the driver, for literals such as search queries."""
    return " ".join(re.sub(BLANK, " ", unicodedata.normalize("NFKC", text)).split(" ")).strip().lower()


def nfkc(text: Column) -> Column:
    return _only_where_needed(text, _normal_form("NFKC"))


def nfc(text: Column) -> Column:
    return _only_where_needed(text, _normal_form("NFC"))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def canonical_key(text: Column, ascii_text: bool = False) -> Column:
    """The key under which two spellings of a name are one record.

    ``ascii_text`` is for callers that know the column is ASCII (ids, enum
    names); it keeps the expression free of Python.
    """
    return F.lower(collapse_blanks(text if ascii_text else nfkc(text)))


def normalize_query(text: Column, ascii_text: bool = False) -> Column:
    return canonical_key(text, ascii_text)


def normalize_alias(text: Column, ascii_text: bool = False) -> Column:
    return canonical_key(F.regexp_replace(text, "[-_]+", " "), ascii_text)


def characters(text: Column) -> Column:
    """One array entry per code point."""
    return F.filter(F.split(text, ""), lambda ch: ch != "")


def slugify(text: Column, ascii_text: bool = False) -> Column:
    """Route text: letters and digits joined by dashes, else the code points in hex."""
    plain = text if ascii_text else _only_where_needed(text, _without_marks)
    dashed = F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    composed = text if ascii_text else nfc(text)
    code_points = F.array_join(
        F.transform(characters(composed), lambda ch: F.lower(F.hex(F.ascii(ch)))), "-"
    )
    return F.when(F.length(slug) > 0, slug).otherwise(code_points)


def entity_id(kind, name: Column, ascii_text: bool = False) -> Column:
    kind_column = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind_column, canonical_key(name, ascii_text))


def stable_suffix(text: Column, ascii_text: bool = False) -> Column:
    """Seven base-36 digits of the FNV-1a hash over code points."""
    mixed = F.aggregate(
        characters(text if ascii_text else nfc(text)),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(
            F.lit(4294967295).cast("bigint")
        ),
    )
    return F.lpad(F.lower(F.conv(mixed.cast("string"), 10, 36)), 7, "0")


def code_unit_order(text: Column) -> Column:
    """Sort key that orders text by UTF-16 code units, as stored output requires."""
    return F.encode(text, "UTF-16BE")


def route_matches(slug: Column, aliases: Column, wanted: Column) -> Column:
    return (slug == wanted) | F.coalesce(F.array_contains(aliases, wanted), F.lit(False))
