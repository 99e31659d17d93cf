"""Scalar functions on text as column expressions. Only Unicode's compatible form, which Spark lacks, comes from an Arrow function, for texts that need it."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: white space and punctuation that don't count when sentences are compared.
_SURFACE = r"(?U)[\s，,。；;：:！？!?]+"
#: Fixed: Chinese digits with the Arabic ones that they stand for.
DIGITS, ARABIC = "零〇一二两三四五六七八九", "001223456789"
_ZEROS, _ONES = DIGITS[:2], DIGITS[2:]
#: Fixed: days by their distance from the reference date.
RELATIVE_DAYS = {"今天": 0, "昨天": -1, "明天": 1}
#: Fixed: words of a claim and its quotes that must be the same on both sides.
MARKERS = ("不是", "并非", "最多", "至少", "上限", "下限", "首次响应", "最终解决")
#: Fixed: words that make a statement doubtful.
DOUBTS = ("不是", "并非", "不", "未", "否", "非", "无", "未知", "不确定", "存疑", "尚待", "待确认", "无法判断")
#: Grammar of numbers. Patterns hold for Java and Python alike.
_DECIMAL = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_NUMERALS = DIGITS + "十百千"
_FILL, _LEAD, _NEXT = f"[{_ZEROS}]*", f"([{DIGITS}])", f"([{_ONES}])"
#: A numeral by its greatest power: a digit before each power, powers falling, zeros between for what is skipped, and a digit that may close it. What its parts count; only the first may be left out and then is one.
_BY_POWER = (
    (f"{_LEAD}千{_FILL}(?:{_NEXT}百{_FILL})?(?:{_NEXT}十{_FILL})?{_NEXT}?", (1000, 100, 10, 1)),
    (f"{_LEAD}百{_FILL}(?:{_NEXT}十{_FILL})?{_NEXT}?", (100, 10, 1)),
    (f"{_LEAD}?十{_FILL}{_NEXT}?", (10, 1)),
)
_ISO_DATE = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
_SMALL = f"[0-9{DIGITS}十]+"
_LONG_DATE = f"(?:([0-9{_NUMERALS}]+)年)?({_SMALL})月({_SMALL})日"
#: Fixed: what stands beside 日 and 月 where they are parts of dates. An empty text is the end.
_BEFORE_DAY, _BEFORE_MONTH, _AFTER_MONTH = "月", "年", ("", "日", "十", *"0123456789", *DIGITS)
#: Texts that are their own compatible form: ASCII, precomposed Latin letters, unified ideographs, and two marks.
_PLAIN = "^[\\p{ASCII}\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014c-\u017e\u4e00-\u9fff\u3001\u3002]*$"
_SPACE = r"[\s\x1c-\x1f]+"


# native


def surface_sentence(text: Column) -> Column:
    return F.regexp_replace(text, _SURFACE, "")


def span_matches(text: Column, start: Column, end: Column, quoted: Column) -> Column:
    """Whether the code points from start to end (exclusive) of the text are just the quoted ones."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == quoted), F.lit(False))


def sanitised_code(code: Column) -> Column:
    """A code that is safe to log, else UNSAFE_ISSUE_CODE."""
    return F.when(code.rlike("^[A-Z][A-Z0-9_]{0,63}$"), code).otherwise("UNSAFE_ISSUE_CODE")


def shared_markers(claim: Column, quote: Column) -> Column:
    """Whether each marker word is in both texts or in neither."""
    return F.forall(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(claim, m) == F.contains(quote, m))


def compatible(text: Column | str) -> Column:
    """Unicode's compatible form (NFKC). Only texts that may differ from theirs go to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(_PLAIN)
    return F.when(plain, text).otherwise(run(F.when(~plain, text)))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}|{_SPACE}$", "")


def nfkc_surface(text: Column | str) -> Column:
    """Width and white space normalised."""
    return F.regexp_replace(_trimmed(compatible(text)), f"(?U){_SPACE}", " ")


def _number(token: Column) -> Column:
    """The number of a token in compatible form, without spaces around it, as plain text; NULL if it is none."""
    whole = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    bare = F.regexp_replace(token, "^[+-]", "")
    arabic = F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), F.when(F.startswith(bare, F.lit(".")), F.concat(F.lit("0"), bare)).otherwise(whole(bare)))
    digit = lambda x: F.translate(x, DIGITS, ARABIC).try_cast("long")
    out = F.when(token.rlike(f"^{_DECIMAL}$"), arabic).when(token.rlike(f"^[{DIGITS}]+$"), whole(F.translate(token, DIGITS, ARABIC)))
    for pattern, weights in _BY_POWER:
        parts = [F.coalesce(digit(F.regexp_extract(token, f"^{pattern}$", i + 1)), F.lit(int(i == 0))) * w for i, w in enumerate(weights)]
        out = out.when(token.rlike(f"^{pattern}$"), sum(parts[1:], parts[0]).cast("string"))
    return out


def parse_number(token: Column | str) -> Column:
    """An Arabic number or a Chinese one (digits read off, or digits before falling powers of ten) as plain text, so that its scale is kept."""
    return _number(_trimmed(compatible(token)))


def parse_date(token: Column, as_of: Column, year: Column | None = None) -> Column:
    """A relative day, an ISO date, or one with 年, 月 and 日, without a year in it only if one is given; NULL if there is no such day."""
    token = _trimmed(compatible(token))
    relative = F.create_map(*[F.lit(x) for pair in RELATIVE_DAYS.items() for x in pair])
    iso = lambda i: F.regexp_extract(token, f"^{_ISO_DATE}$", i)
    long = lambda i: _number(F.regexp_extract(token, f"^{_LONG_DATE}$", i))

    def made(y: Column, m: Column, d: Column) -> Column:
        good = y.rlike("^[0-9]{1,4}$") & ~y.rlike("^0+$") & m.rlike("^[0-9]{1,2}$") & d.rlike("^[0-9]{1,2}$")
        return F.when(good, F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date"))

    given = F.lit(None).cast("string") if year is None else year.cast("string")
    return (
        F.when(F.map_contains_key(relative, token), F.date_add(as_of, F.try_element_at(relative, token)))
        .when(token.rlike(f"^{_ISO_DATE}$"), made(iso(1), iso(2), iso(3)))
        .when(token.rlike(f"^{_LONG_DATE}$"), made(F.coalesce(long(1), given), long(2), long(3)))
    )


#: What amounts are found as.
AMOUNTS = "array<struct<kind:string,raw:string,unit_code:string>>"


def unit_names(units: Sequence[tuple[str, Sequence[str], str]]) -> dict[str, tuple[str, str]]:
    """Unit code and kind of value by name. units: (unit_code, aliases, dimension) each; a name of two units is an error."""
    out: dict[str, tuple[str, str]] = {}
    for code, aliases, dimension in units:
        kind = dimension if dimension in ("duration", "money") else "quantity"
        for name in {unicodedata.normalize("NFKC", a) for a in aliases}:
            if out.setdefault(name, (code, kind))[0] != code:
                raise ValueError(f"the alias {name} belongs to two units")
    return out


#: What every amount has before its unit's name: the last character of a number.
_NUMBER_END = f"[0-9{_NUMERALS}]\\s*"


def _listed(names: Iterable[str]) -> str:
    """Names as alternatives of a pattern, longest first."""
    return "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))


def _amounts(names: Iterable[str]) -> str:
    """A number and a unit's name, the longest that fits: groups number after a month, number after a year, any other number, name, character after."""
    listed = _listed(names)
    number = f"([+-]?(?:[0-9]+(?:\\.[0-9]+)?|[{_NUMERALS}]+))"
    return f"(?:(?<={_BEFORE_DAY}){number}|(?<={_BEFORE_MONTH}){number}|{number})\\s*({listed})(?=((?s:.))|)"


def literals_by(text: Column, names: Column) -> Column:
    """The text's amounts as literals() finds them, by names of the row itself: array of (name in compatible form, unit_code, kind), each name once."""
    quoted = F.transform(F.array_sort(F.transform(names, lambda x: F.struct((-F.length(x["name"])).alias("n"), x["name"].alias("name")))), lambda x: F.concat(F.lit("\\Q"), x["name"], F.lit("\\E")))
    filled = lambda parts: F.concat(F.lit("(?U)" + parts[0] + "("), F.array_join(quoted, "|"), F.lit(")" + parts[1]))
    pattern, end = filled(_amounts("").split("()")), filled((_NUMBER_END, ""))
    some = lambda t: F.exists(names, lambda x: F.contains(t, x["name"])) & F.regexp_like(t, end)
    return F.when(text.isNull(), None).when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.array().cast(AMOUNTS)).otherwise(_found(compatible(text), pattern, some, lambda name, part: F.try_element_at(F.map_from_entries(F.transform(names, lambda x: F.struct(x["name"], x[part]))), name)))


def _found(plain: Column, pattern: Column, some: Callable[[Column], Column], told: Callable[[Column, str], Column]) -> Column:
    """The amounts of a text in compatible form. Only a text that `some` holds for, which has an end of a number with a unit's name, is read for the groups of the pattern, once for each. The text and each token are bound by a
    function on an array, so that what makes them is worked out once."""
    part = lambda text, i: F.regexp_extract_all(text, pattern, F.lit(i))
    groups = lambda text: F.arrays_zip(*[part(text, i + 1).alias(name) for i, name in enumerate(("month", "year", "other", "name", "after"))])
    dated = lambda x: ((x["name"] == "日") & (x["month"] != "")) | ((x["name"] == "月") & ((x["year"] != "") | x["after"].isin(*_AFTER_MONTH)))
    token = lambda x: F.struct(x["name"].alias("name"), F.concat(x["month"], x["year"], x["other"]).alias("token"))
    amount = lambda x: F.struct(told(x["name"], "kind").alias("kind"), _number(x["token"]).alias("raw"), told(x["name"], "unit_code").alias("unit_code"))
    read = lambda text: F.filter(F.transform(F.transform(F.filter(groups(text), lambda x: ~dated(x)), token), amount), lambda x: x["raw"].isNotNull()).cast(AMOUNTS)
    return F.get(F.transform(F.array(plain), lambda text: F.when(text.isNotNull(), F.when(some(text), read(text)).otherwise(F.array().cast(AMOUNTS)))), F.lit(0))


def literals(text: Column, units: Sequence[tuple[str, Sequence[str], str]]) -> Column:
    """The text's amounts, in order: array of (kind, raw: number as text, unit_code). A 日 after 月, and a 月 within a date or at the end, are parts of dates and no amounts."""
    names = unit_names(units)
    if not names:
        return F.when(text.isNotNull(), F.array().cast(AMOUNTS))
    maps = {part: F.create_map(*[F.lit(x) for n, own in names.items() for x in (n, own[i])]) for i, part in enumerate(("unit_code", "kind"))}
    end = F.lit(f"(?U){_NUMBER_END}(?:{_listed(names)})")
    some = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(n)) for n in sorted(names)]) & F.regexp_like(t, end)
    return _found(compatible(text), F.lit("(?U)" + _amounts(names)), some, lambda name, part: maps[part][name])


# the same for single texts on the driver


def surface(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


_TO_ARABIC = str.maketrans(DIGITS, ARABIC)


def number(token: str) -> Decimal | None:
    token = unicodedata.normalize("NFKC", token).strip()
    if re.fullmatch(_DECIMAL, token) or re.fullmatch(f"[{DIGITS}]+", token):
        return Decimal(token.translate(_TO_ARABIC))
    for pattern, weights in _BY_POWER:
        if m := re.fullmatch(pattern, token):
            parts = [g or ("0" if i else "1") for i, g in enumerate(m.groups())]
            return Decimal(sum(w * int(p.translate(_TO_ARABIC)) for p, w in zip(parts, weights, strict=True)))
    return None


def day(token: str, as_of: dt.date, year: int | None = None) -> dt.date | None:
    token = unicodedata.normalize("NFKC", token).strip()
    if token in RELATIVE_DAYS:
        return as_of + dt.timedelta(days=RELATIVE_DAYS[token])
    m = re.fullmatch(f"{_ISO_DATE}|{_LONG_DATE}", token)
    y, *rest = [g for g in m.groups() if g] if m else [""]
    parts = [y, *rest] if len(rest) == 2 else [str(year or ""), y, *rest]
    numbers = [number(p) for p in parts]
    try:
        return dt.date(*map(int, numbers)) if m and None not in numbers else None
    except ValueError:
        return None


class Literals:
    """Amounts of single texts; units as in literals()."""

    def __init__(self, units: Sequence[tuple[str, Sequence[str], str]]):
        self.names = unit_names(units)

    def find(self, text: str) -> list[tuple[str, str, str]]:
        text = unicodedata.normalize("NFKC", text)
        found = re.findall(_amounts(self.names), text) if self.names else []
        dated = lambda month, year, name, after: (name == "日" and month) or (name == "月" and (year or after in _AFTER_MONTH))
        amounts = [(number(month + year + other), name) for month, year, other, name, after in found if not dated(month, year, name, after)]
        return [(self.names[name][1], format(n, "f"), self.names[name][0]) for n, name in amounts if n is not None]
