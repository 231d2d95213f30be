"""Building blocks: a field value together with the findings that its text earns.

A finding is ``struct<severity, code, message, details>``. Values and findings
of one declaration are separate expressions over the same record, so Spark
computes only those a query asks for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexemes
from ..functions.keys import canonical_key, slugify
from ..functions.labels import asset_path, asset_path_unsafe
from ..functions.records import attribute, attribute_key
from ..operators.merge import json_text

FINDING = "struct<severity:string,code:string,message:string,details:map<string,string>>"
_CHECK = "struct<text:string,shown:string,rule:string>"


def finding(condition: Column, code: str, message, severity: str = "warning", **details) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    pairs = [x for name, value in details.items() for x in (F.lit(name), value if isinstance(value, Column) else F.lit(value))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(condition, F.struct(F.lit(severity), F.lit(code), text, made).cast(FINDING))


def present(findings: list) -> Column:
    """Built findings, of those whose condition holds; grammar checks share one expression."""
    built = [f.build() if isinstance(f, Report) else f for f in findings if not isinstance(f, Check)]
    checks = [f.build() for f in findings if isinstance(f, Check)]
    parts = []
    if built:
        parts.append(F.filter(F.array(*built), lambda f: f.isNotNull()))
    if checks:
        parts.append(run_checks(F.array(*checks)))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(f"array<{FINDING}>")


class Report:
    """A finding that is built only when findings are asked for."""

    def __init__(self, condition, code, message, severity, details):
        self.condition, self.rest = condition, (code, message, severity, details)

    def when(self, guard: Column) -> "Report":
        return Report(guard & self.condition, *self.rest)

    def build(self) -> Column:
        code, message, severity, details = self.rest
        return finding(self.condition, code, message, severity, **details)


class Check:
    """A text that must follow the number or flag grammar.

    The rule is data (kind, bounds, wording), so all checks of a record run
    through one lambda instead of one expression each.
    """

    def __init__(self, text: Column, shown, rule: tuple, guard: Column | None = None):
        self.text, self.shown, self.rule, self.guard = text, shown, rule, guard

    def when(self, guard: Column) -> "Check":
        return Check(self.text, self.shown, self.rule, guard if self.guard is None else guard & self.guard)

    def build(self) -> Column:
        """Null where the text is absent or the guard does not hold: such a check finds nothing, so nothing of it is evaluated."""
        rule = "|".join("" if x is None else str(x) for x in self.rule)
        shown = self.shown() if callable(self.shown) else self.shown
        given = self.text.isNotNull()
        return F.when(given if self.guard is None else given & self.guard, F.struct(self.text, shown, F.lit(rule)).cast(_CHECK))


def rule_text(kind: str, low=None, high=None, used: str = "an unavailable value", blank: bool = False) -> tuple:
    """(kind, low, high, expected, used, wording for blank text)."""
    if kind in ("flag", "bit"):
        return (kind, None, None, "0 or 1" if kind == "bit" else "0, 1, false, or true", used, None)
    noun = "an integer" if kind == "integer" else "a number"
    expected = noun if kind == "integer" else "a finite number"
    if low is not None:
        expected = f"{noun} greater than or equal to {low}" if high is None else f"{noun} from {low} to {high}"
    blank_text = (expected if high is not None else f"a non-negative {kind}") if blank else None
    return (kind, low, high, expected, used, blank_text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; an expression inside a lambda is else evaluated at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_checks(checks: Column) -> Column:
    """Findings of an array of checks."""
    def verdict(c: Column) -> Column:
        def ruled(rule: Column) -> Column:
            kind, low, high = rule[0], *(F.when(r != "", r.cast("double")) for r in (rule[1], rule[2]))
            blank = (rule[5] != "") & (F.trim(c["text"]) == "")
            numeric = kind.isin("integer", "number")

            def in_range(value: Column) -> Column:
                return value.isNotNull() & F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))

            number = F.when(kind == "integer", lexemes.source_integer(c["text"]).cast("double")).otherwise(lexemes.source_number(c["text"]))
            bad = (
                F.when(numeric, blank | ((c["text"] != "") & ~bound(number, in_range)))
                .when(kind == "bit", ~c["text"].isin("0", "1"))
                .otherwise(~c["text"].isin("0", "1", "true", "false"))
            )
            message = F.concat(F.lit("Expected "), F.when(blank, rule[5]).otherwise(rule[3]), F.lit(" for "), c["shown"],
                               F.lit("; used "), rule[4], F.lit(" instead."))
            code = F.when(numeric, "invalid_number").otherwise("invalid_boolean")
            details = F.create_map(F.lit("field"), json_text(c["shown"]), F.lit("value"), json_text(c["text"]))
            return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit("warning"), code, message, details).cast(FINDING))

        return bound(F.split(c["rule"], r"\|"), ruled)

    return F.filter(F.transform(F.filter(checks, lambda c: c.isNotNull()), verdict), lambda f: f.isNotNull())


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def built(value) -> Column:
    return value() if callable(value) else value


@dataclass
class Part:
    """Values by name and the findings that belong to them; nested lists are built on demand."""

    values: dict = field(default_factory=dict)
    findings: list = field(default_factory=list)
    drifts: list = field(default_factory=list)

    def all_findings(self) -> Column:
        return F.concat(present(self.findings), *[built(d) for d in self.drifts])

    def struct(self) -> Column:
        return F.struct(*[built(value).alias(name) for name, value in self.values.items()])


class Reader:
    """Reads attributes of one record into a ``Part``; ``label`` heads the field names in messages."""

    def __init__(self, record: Column, label=""):
        self.record, self.label, self.part = record, label, Part()

    def text_of(self, names) -> Column:
        if isinstance(names, str):
            return attribute(self.record, names)
        return F.coalesce(*[attribute(self.record, n) for n in names])

    def field_name(self, text) -> Column:
        shown = text if isinstance(text, Column) else F.lit(text)
        if isinstance(self.label, str):
            return F.concat(F.lit(self.label + " "), shown) if self.label else shown
        return F.concat(self.label, F.lit(" "), shown)

    def _check(self, text, title, rule):
        self.part.findings.append(Check(text, lambda: self.field_name(title), rule))

    def _number(self, name, attrs, kind, fallback, low, high, title, blank):
        text = self.text_of(attrs)
        used = "an unavailable value" if fallback is None else str(fallback)
        self._check(text, name if title is None else title, rule_text(kind, low, high, used, blank))
        whole = kind == "integer"
        if fallback is None:
            value = (lexemes.optional_integer if whole else lexemes.optional_number)(text, low, high)
        else:
            value = (lexemes.integer_or if whole else lexemes.number_or)(text, fallback, low, high)
        self.part.values[name] = value
        return value

    def integer(self, name, attrs, fallback=None, low=None, high=None, title=None, blank=False):
        return self._number(name, attrs, "integer", fallback, low, high, title, blank)

    def number(self, name, attrs, fallback=None, low=None, high=None, title=None, blank=False):
        return self._number(name, attrs, "number", fallback, low, high, title, blank)

    def flag(self, name, attrs, optional=True, binary=False, title=None):
        text = self.text_of(attrs)
        used = "an unavailable value" if optional else "false"
        self._check(text, name if title is None else title, rule_text("bit" if binary else "flag", used=used))
        value = lexemes.optional_bit(text) if binary else lexemes.optional_flag(text) if optional else lexemes.flag(text)
        self.part.values[name] = value
        return value

    def text(self, name, attrs, blank_is_null=True):
        text = self.text_of(attrs)
        self.part.values[name] = F.when(F.trim(text) != "", text) if blank_is_null else text
        return self.part.values[name]

    def asset(self, name, attrs):
        text = self.text_of(attrs)
        self.report(F.coalesce(text != "", F.lit(False)) & asset_path_unsafe(text), "unsafe_asset_path",
                    F.concat(F.lit("Unsafe relative path: "), text), severity="error", assetPath=json_text(text))
        self.part.values[name] = asset_path(text)
        return self.part.values[name]

    def reference(self, name, attrs):
        """A reference by name: ``<name>_key`` and ``<name>_name``, both null when blank."""
        text = self.text_of(attrs)
        named = F.when(F.trim(text) != "", text)
        self.part.values[f"{name}_key"] = attribute_key(self.record, *([attrs] if isinstance(attrs, str) else attrs))
        self.part.values[f"{name}_name"] = named
        return named

    def report(self, condition, code, message, severity="warning", **details):
        self.part.findings.append(Report(condition, code, message, severity, details))

    def drift(self, element: str, allowed: set[str], elements: set[str] | None = frozenset()):
        """Attributes and child elements outside the allow-list."""
        self.part.drifts.append(lambda: drift(self.record, element, set(allowed), elements))


def drift(record: Column, element: str, attributes: set[str], elements: set[str] | None, partial: set[str] = frozenset(),
          values: bool = True) -> Column:
    """Findings for unknown attributes and child elements, in stored order."""
    unknown = F.sort_array(F.array_except(F.map_keys(record["attrs"]), F.array(*[F.lit(a) for a in sorted(attributes)]).cast("array<string>")))

    def about_attribute(name: Column) -> Column:
        details = [F.lit("attribute"), json_text(name), F.lit("element"), json_text(F.lit(element))]
        if values:
            details += [F.lit("value"), json_text(record["attrs"][name])]
        return F.struct(
            F.lit("warning").alias("severity"), F.lit("unknown_attribute").alias("code"),
            F.concat(F.lit(f"Unsupported {element} attribute "), name, F.lit(" was preserved only as a diagnostic.")).alias("message"),
            F.create_map(*details).alias("details")).cast(FINDING)

    found = F.transform(unknown, about_attribute)
    if elements is None:
        return found
    return F.concat(found, unknown_children(record, elements, partial))


def unknown_children(record: Column, elements: set[str], partial: set[str] = frozenset(), any_case: set[str] = frozenset()) -> Column:
    tags = F.array_distinct(F.transform(record["children"], lambda c: c["tag"]))
    allowed = [F.lit(e) for e in sorted(elements)]
    strange = F.filter(tags, lambda t: ~t.isin(*allowed) & ~F.lower(t).isin(*[F.lit(e) for e in sorted(any_case)])) if any_case and allowed else (
        F.filter(tags, lambda t: ~t.isin(*allowed)) if allowed else tags)

    def about(tag: Column) -> Column:
        partly = tag.isin(*[F.lit(p) for p in sorted(partial)]) if partial else F.lit(False)
        return F.struct(
            F.lit("warning").alias("severity"),
            F.when(partly, "partially_supported_element").otherwise("unknown_element").alias("code"),
            F.when(partly, F.concat(F.lit("Supported fields from <"), tag, F.lit("> were normalized, but other content remains unmodeled.")))
            .otherwise(F.concat(F.lit("Unsupported <"), tag, F.lit("> element was preserved only as a diagnostic."))).alias("message"),
            F.create_map(F.lit("element"), json_text(tag)).alias("details")).cast(FINDING)

    return F.transform(F.sort_array(strange), about)


def each(children: Column, read: Callable[[Column, Column], Part]) -> tuple[Callable, Callable]:
    """(array of structs, findings) for a list of child records, each built on demand."""
    def values() -> Column:
        return F.transform(children, lambda c, i: read(c, i).struct())

    def findings() -> Column:
        return F.flatten(F.transform(children, lambda c, i: read(c, i).all_findings()))

    return values, findings


def gather(*parts) -> Callable:
    """Findings of several lists, built on demand."""
    return lambda: F.concat(*[built(p) for p in parts])


def nth(index: Column) -> Column:
    """Declarations count from one in messages."""
    return (index + 1).cast("string")


def entity(records: DataFrame, kind: str, name: Column, description: Column, values: dict, findings) -> DataFrame:
    """The common columns of an entity next to its own fields.

    ``records`` has ``record, source_id, file, precedence``.
    """
    record = F.col("record")
    named = records.withColumn("_name", name)
    return named.select(
        F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), canonical_key(F.col("_name"))).alias("id"),
        canonical_key(F.col("_name")).alias("canonical_key"), slugify(F.col("_name")).alias("slug"), F.col("_name").alias("name"),
        F.coalesce(description, F.lit("")).alias("description"), "precedence", "source_id", "file", record["line"].alias("line"),
        record["column"].alias("column"), F.col("_name").alias("original_name"),
        F.when(attribute(record, "id") != "", attribute(record, "id")).alias("original_id"),
        *[built(value).alias(column) for column, value in values.items()], built(findings).alias("findings"),
    )


def nameless(records: DataFrame, element: str) -> DataFrame:
    """Errors for records without the required name."""
    missing = F.coalesce(attribute(F.col("record"), "name"), F.lit("")) == ""
    return records.filter(missing).select(
        F.lit("error").alias("severity"), F.lit("missing_entity_name").alias("code"),
        F.lit(f"{'An' if element[0] in 'aeiou' else 'A'} <{element}> is missing its required name attribute.").alias("message"),
        "source_id", "file", F.col("record.line").alias("line"), F.col("record.column").alias("column"),
        F.lit(None).cast("string").alias("entity_id"), F.create_map().cast("map<string,string>").alias("details"))


def with_name(records: DataFrame) -> DataFrame:
    return records.filter(F.coalesce(attribute(F.col("record"), "name"), F.lit("")) != "")


def drafts(entities: DataFrame) -> DataFrame:
    """Findings of entities as diagnostic drafts."""
    rows = entities.select("id", "source_id", "file", "line", "column", F.explode("findings").alias("f"))
    return rows.select("f.severity", "f.code", "f.message", "source_id", "file", "line", "column", F.col("id").alias("entity_id"), "f.details")
