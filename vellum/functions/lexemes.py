"""Strict number and flag grammars. A text that does not match is a null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted spellings and the largest exact integer.
INTEGER = r"^-?[0-9]+$"
DECIMAL = r"^-?([0-9]+(\.[0-9]+)?|\.[0-9]+)$"
SAFE_INTEGER = 9007199254740991


def source_integer(text: Column) -> Column:
    value = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    return F.when(F.abs(value) <= SAFE_INTEGER, value)


def source_number(text: Column) -> Column:
    value = F.when(text.rlike(DECIMAL), text.try_cast("double"))
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value)


def _bounded(value: Column, low, high) -> Column:
    if low is not None:
        value = F.when(value >= low, value)
    if high is not None:
        value = F.when(value <= high, value)
    return value


def _absent(text: Column) -> Column:
    return text.isNull() | (text == "")


def integer_or(text: Column, fallback, low=None, high=None) -> Column:
    """A required integer: absent or rejected text gives the fallback."""
    return F.coalesce(_bounded(source_integer(text), low, high), F.lit(fallback).cast("bigint"))


def optional_integer(text: Column, low=None, high=None) -> Column:
    return _bounded(source_integer(text), low, high)


def number_or(text: Column, fallback, low=None, high=None) -> Column:
    return F.coalesce(_bounded(source_number(text), low, high), F.lit(fallback).cast("double"))


def optional_number(text: Column, low=None, high=None) -> Column:
    return _bounded(source_number(text), low, high)


def integer_rejected(text: Column, low=None, high=None) -> Column:
    """True where the text earns an ``invalid_number`` diagnostic."""
    return ~_absent(text) & _bounded(source_integer(text), low, high).isNull()


def number_rejected(text: Column, low=None, high=None) -> Column:
    return ~_absent(text) & _bounded(source_number(text), low, high).isNull()


def flag(text: Column) -> Column:
    """Missing or unreadable is false."""
    return F.coalesce(text.isin("1", "true"), F.lit(False))


def flag_rejected(text: Column) -> Column:
    return text.isNotNull() & ~text.isin("0", "1", "true", "false")


def optional_flag(text: Column) -> Column:
    return F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False)


def optional_bit(text: Column) -> Column:
    return F.when(text == "1", True).when(text == "0", False)


def bit_rejected(text: Column) -> Column:
    return text.isNotNull() & ~text.isin("0", "1")


def one_in_to_percent(n: Column) -> Column:
    """Percent chance of a one-in-n event, halves rounded up."""
    return F.when(n > 0, F.floor(F.lit(100.0) / n + F.lit(0.5)))


def signed_byte(text: Column) -> Column:
    return optional_integer(text, -128, 127)


def positive_integer(text: Column) -> Column:
    return optional_integer(text, 1, None)


def distance_limit(length: Column) -> Column:
    """How many edits a spelling suggestion may be away."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(length * F.lit(0.25)).cast("int")))
