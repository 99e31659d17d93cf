"""Typed values: one struct with a column for each storage class, told apart by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind:string,s:string,b:boolean,n:decimal(38,18),d:date,ts:timestamp,local_date:date,unit_code:string,raw:string>"
#: Fixed: kinds by how they compare.
UNIT_KINDS = ("duration", "money", "quantity")
NUMERIC_KINDS = ("decimal", *UNIT_KINDS)
ORDERED_KINDS = ("integer", *NUMERIC_KINDS)
#: Fixed: what decimal text looks like. A cast alone takes more, such as 1e3 or .5.
DECIMAL_TEXT = r"^[+-]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"


def value(kind: str | Column, **parts: Column) -> Column:
    """A value of this kind; parts: s, b, n, d, ts, local_date, unit_code, raw."""
    kinds = dict(x.split(":") for x in VALUE[7:-1].replace("decimal(38,18)", "decimal").split(","))
    kinds["n"] = "decimal(38,18)"
    own = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | parts
    return F.struct(*[own.get(name, F.lit(None)).cast(to).alias(name) for name, to in kinds.items()])


#: What decimal(38,18) holds as it is; other numbers stay as text and are compared by it.
HELD = r"^[+-]?[0-9]{1,20}(?:\.[0-9]{1,18}0*)?$"


def held(text: Column) -> Column:
    """A number's text as decimal(38,18), NULL if that can't hold it whole."""
    return F.when(text.rlike(HELD), text.try_cast("decimal(38,18)"))


def decimal_from_text(text: Column) -> Column:
    """The number that canonical decimal text stands for, else NULL; also NULL for more digits than decimal(38,18) has."""
    return F.when(text.rlike(DECIMAL_TEXT), held(text))


#: What canonical() leaves out of a number's text, in this order; each step names its input once, so that plans stay small.
_SHORTER = ((r"^\+", ""), (r"^(-?)0*(?=[0-9])", "$1"), (r"^(-?)(?=\.)", "$10"), (r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^-0$", "0"))


def canonical(number: Column) -> Column:
    """One text for each number, of any length: no plus, no zeros that don't count, and no minus before 0."""
    for pattern, left in _SHORTER:
        number = F.regexp_replace(number, pattern, left)
    return number


def order_key(number: Column) -> Column:
    """A text by whose order numbers of any length are in theirs: sign, number of whole digits, digits; those of negative numbers turned round."""
    return _key(canonical(number))


def _key(text: Column) -> Column:
    """order_key() of canonical text."""
    bare = F.ltrim(text, F.lit("-"))
    size = F.concat(F.lpad(F.length(F.substring_index(bare, ".", 1)).cast("string"), 10, "0"), F.translate(bare, ".", ""))
    return F.when(F.startswith(text, F.lit("-")), F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("1"), size))


def _sign(x: Column, y: Column) -> Column:
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def _long_sign(a: Column, b: Column) -> Column:
    """_sign() of two numbers of any length. It is a function on an array, so that it adds one call to compiled code, where it is seldom reached."""
    text = lambda v: F.coalesce(v["raw"], v["n"].cast("string"))
    keys = F.transform(F.transform(F.array(text(a), text(b)), canonical), _key)
    return F.element_at(F.transform(F.array(keys), lambda k: _sign(F.get(k, F.lit(0)), F.get(k, F.lit(1)))), 1)


def same_domain(a: Column, b: Column) -> Column:
    """Whether two values may be compared: equal kinds, and equal units for what has units."""
    return (a["kind"] == b["kind"]) & (~a["kind"].isin(*UNIT_KINDS) | F.coalesce(a["unit_code"] == b["unit_code"], F.lit(False)))


def same_value(a: Column, b: Column) -> Column:
    """Equality within a domain: by number for numeric kinds (8 is 8.0), else by the kind's own column. False across domains."""
    own = (
        F.when(a["kind"].isin(*ORDERED_KINDS), F.coalesce(a["n"] == b["n"], _long_sign(a, b) == 0))
        .when(a["kind"] == "boolean", a["b"] == b["b"])
        .when(a["kind"] == "date", a["d"] == b["d"])
        .when(a["kind"] == "datetime", a["ts"] == b["ts"])
        .otherwise(a["s"] == b["s"])
    )
    return same_domain(a, b) & F.coalesce(own, F.lit(False))


def identical(a: Column, b: Column) -> Column:
    """Equality as written: 8 and 8.0 differ. This decides whether two facts conflict."""
    text = F.when(a["kind"].isin(*NUMERIC_KINDS), F.coalesce(a["raw"] == b["raw"], a["n"] == b["n"])).otherwise(same_value(a, b))
    return same_domain(a, b) & F.coalesce(text, F.lit(False))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for values of one ordered domain: numbers of any length, dates or instants; NULL for others."""
    kind = a["kind"]
    numbers = F.coalesce(_sign(a["n"], b["n"]), _long_sign(a, b))
    return F.when(kind.isin(*ORDERED_KINDS), numbers).when(kind == "date", _sign(a["d"], b["d"])).when(kind == "datetime", _sign(a["ts"], b["ts"]))
