"""Strict record schemas: declared once, compiled to an expression over VARIANT that lists every place where a record breaks its schema.

A place is the keys and list positions on the way to it, joined by dots; <root> is the record itself. Nothing is converted: a text is no number and
5.0 no whole number. Records are closed unless they are said to be open; a rule over several parts of a record is only asked where all of its
parts are right.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "<root>"
_NONE = "array<string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "") == ""


@dataclass(frozen=True)
class Text:
    """A text; not blank unless it may be, one of some, or one that a pattern fits and that passes a test."""

    may_be_blank: bool = False
    one_of: tuple[str, ...] = ()
    pattern: str | None = None
    test: Callable[[Column], Column] | None = None

    def holds(self, text: Column) -> Column:
        out = F.lit(True) if self.may_be_blank else ~blank(text)
        if self.one_of:
            out &= text.isin(*self.one_of)
        if self.pattern:
            out &= text.rlike(self.pattern)
        return out & self.test(text) if self.test else out


@dataclass(frozen=True)
class Whole:
    least: int | None = None


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class Null:
    """Null, or what else is declared."""

    other: object


@dataclass(frozen=True)
class List:
    item: object
    least: int = 0


@dataclass(frozen=True)
class Maybe:
    """A part that may be left out."""

    kind: object


Parts = Callable[[str, str], Column]


@dataclass(frozen=True)
class Rule:
    """A test over parts(key, type), which is NULL for what has another type. Without a key it is asked when the record is right in itself, and its place is the record's; with one, as soon as it isn't NULL."""

    holds: Callable[[Parts], Column]
    at: str | None = None


@dataclass(frozen=True)
class Record:
    parts: Mapping[str, object]
    rules: tuple[Rule, ...] = ()
    open: bool = False


@dataclass(frozen=True)
class Union:
    """A record of the kind that its part `by` names; that name is part of the place."""

    by: str
    options: Mapping[str, Record] = field(default_factory=dict)


def strict_json(text: Column) -> Column:
    """The text's JSON value as VARIANT; NULL if it is none, if anything follows it, or if an object repeats a key.

    The value is read as the first of two members of a list. The second is made from the text itself, so that no text can close the list and bring its own.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]'))), "$", "array<variant>")
    return bound(listed, lambda two: F.when((F.size(two) == 2) & F.coalesce(F.try_variant_get(F.get(two, F.lit(1)), "$", "string") == F.md5(text), F.lit(False)), F.get(two, F.lit(0))))


def _is(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == name, F.lit(False))


def _none() -> Column:
    return F.array().cast(_NONE)


def _unless(good: Column, place: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), _none()).otherwise(F.array(place))


def _under(place: Column | None, key: str | Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return key if place is None else F.concat(place, F.lit("."), key)


def faults(v: Column, kind: object, place: Column | None = None) -> Column:
    """Array of the places where a VARIANT breaks its schema, empty if it doesn't. A NULL of SQL breaks any."""
    own = F.lit(ROOT) if place is None else place
    as_ = lambda t: F.try_variant_get(v, "$", t)
    match kind:
        case Text():
            return _unless(_is(v, "STRING") & kind.holds(as_("string")), own)
        case Whole():
            # what doesn't fit into 64 bits is a decimal without a fraction
            whole = _is(v, "BIGINT") | F.coalesce(F.schema_of_variant(v).rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), F.lit(False))
            return _unless(whole if kind.least is None else whole & (as_("decimal(38,0)") >= kind.least), own)
        case Flag():
            return _unless(_is(v, "BOOLEAN"), own)
        case Null():
            return F.when(_is(v, "VOID"), _none()).otherwise(faults(v, kind.other, place))
        case List():
            each = lambda items: F.flatten(F.transform(items, lambda x, i: faults(x, kind.item, _under(place, i.cast("string")))))
            return bound(as_("array<variant>"), lambda items: F.when(items.isNull() | (F.size(items) < kind.least), F.array(own)).otherwise(each(items)))
        case Record():
            return bound(as_("map<string,variant>"), lambda parts: F.when(parts.isNull(), F.array(own)).otherwise(_record(parts, kind, place)))
        case Union():
            name = lambda parts: F.try_variant_get(F.try_element_at(parts, F.lit(kind.by)), "$", "string")

            def chosen(parts: Column) -> Column:
                out = F.when(parts.isNull() | ~F.coalesce(_is(F.try_element_at(parts, F.lit(kind.by)), "STRING"), F.lit(False)), F.array(own))
                for option, record in kind.options.items():
                    out = out.when(name(parts) == option, _record(parts, record, _under(place, option)))
                return out.otherwise(F.array(own))

            return bound(as_("map<string,variant>"), chosen)
    raise TypeError(f"{kind} is no schema")


def _record(parts: Column, record: Record, place: Column | None) -> Column:
    part = lambda key: F.try_element_at(parts, F.lit(key))
    found = []
    for key, kind in record.parts.items():
        there = faults(part(key), kind.kind if isinstance(kind, Maybe) else kind, _under(place, key))
        found.append(F.when(part(key).isNotNull(), there).otherwise(_none() if isinstance(kind, Maybe) else F.array(_under(place, key))))
    if not record.open:
        more = F.array_sort(F.array_except(F.map_keys(parts), F.array(*map(F.lit, record.parts))))
        found.append(F.transform(more, lambda key: _under(place, key)))
    typed: Parts = lambda key, type_: F.try_variant_get(part(key), "$", type_)
    found += [F.when(~rule.holds(typed), F.array(_under(place, rule.at))).otherwise(_none()) for rule in record.rules if rule.at]
    rules = [F.when(~rule.holds(typed), F.array(F.lit(ROOT) if place is None else place)).otherwise(_none()) for rule in record.rules if not rule.at]
    own = F.array_distinct(F.concat(*found))
    return bound(own, lambda known: F.when(F.size(known) > 0, known).otherwise(F.array_distinct(F.concat(*rules)))) if rules else own


def check(text: Column, kind: object) -> Column:
    """Array of the places where a JSON text breaks its schema; <root> alone for what is no JSON."""
    return bound(strict_json(text), lambda v: F.when(v.isNull(), F.array(F.lit(ROOT))).otherwise(faults(v, kind)))
