"""The rule program: units of policy with conditions, validity, overrides and claims; small, on the driver, and as tables."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.values import DECIMAL_TEXT, HELD, VALUE, held, value
from rulewright.session import SMALL_ROWS

#: Fixed: predicate operators with the least and most values that they take.
OPERATORS = {
    "exists": (0, 0), "not_exists": (0, 0), "eq": (1, 1), "neq": (1, 1), "in": (1, 1 << 30), "not_in": (1, 1 << 30), "gt": (1, 1), "before": (1, 1),
    "on_or_after": (1, 1), "not_before_if_present": (1, 1), "between": (2, 2), "within_natural_days_from_next_day": (1, 1),
}
DATED = ("before", "on_or_after", "not_before_if_present", "between")


@dataclass(frozen=True)
class Value:
    kind: str
    value: object
    unit_code: str | None = None

    def column(self):
        v = self.value
        if self.kind in ("string", "enum"):
            return value(self.kind, s=F.lit(v))
        if self.kind == "boolean":
            return value(self.kind, b=F.lit(v))
        if self.kind == "date":
            return value(self.kind, d=F.lit(v), local_date=F.lit(v))
        if self.kind == "datetime":
            return value(self.kind, ts=F.lit(v), local_date=F.lit(v.date()))
        return value(self.kind, n=held(F.lit(str(v))), unit_code=F.lit(self.unit_code), raw=F.lit(str(v)))

    @classmethod
    def from_json(cls, v: dict) -> Value:
        kind, x = v["kind"], v["value"]
        if kind == "date":
            x = dt.date.fromisoformat(x)
        elif kind == "datetime":
            x = dt.datetime.fromisoformat(x)
            if x.tzinfo is None:
                raise ValueError("a datetime needs its offset")
        elif kind in ("decimal", "duration", "money", "quantity") and not re.fullmatch(DECIMAL_TEXT, x):
            raise ValueError(f"{x} is no decimal text")
        return cls(kind, x, v.get("unit_code"))

    def row(self) -> tuple:
        """The value as a row of VALUE."""
        k, v = self.kind, self.value
        text = str(v) if k in ("integer", "decimal", "duration", "money", "quantity") else None
        number = Decimal(text) if text is not None and re.fullmatch(HELD, text) else None
        local = v if k == "date" else v.date() if k == "datetime" else None
        return (k, v if k in ("string", "enum") else None, v if k == "boolean" else None, number, v if k == "date" else None, v if k == "datetime" else None, local, self.unit_code, text)


@dataclass(frozen=True)
class Predicate:
    field_id: str
    operator: str
    values: tuple[Value, ...] = ()
    related_field_id: str | None = None

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")
        least, most = OPERATORS[self.operator]
        if not least <= len(self.values) <= most:
            raise ValueError(f"{self.operator} takes {least} to {most} values")
        kinds = {v.kind for v in self.values}
        if len(kinds) > 1:
            raise ValueError(f"{self.operator} takes values of one kind")
        if self.operator == "gt" and not kinds <= {"integer", "decimal", "duration", "money", "quantity"}:
            raise ValueError("gt takes a number")
        if self.operator in DATED and not kinds <= {"date", "datetime"}:
            raise ValueError(f"{self.operator} takes dates")
        if self.operator == "within_natural_days_from_next_day":
            days = self.values[0]
            if days.kind != "duration" or Decimal(str(days.value)) <= 0 or Decimal(str(days.value)) % 1 or self.related_field_id in (None, self.field_id):
                raise ValueError("the window takes a whole number of days and another date field")


@dataclass(frozen=True)
class Claim:
    claim_id: str
    canonical_text: str = ""
    literals: tuple[Value, ...] = ()
    evidence_ids: tuple[str, ...] = ()
    qualifiers: tuple[str, ...] = ()
    companions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Unit:
    unit_id: str
    family_id: str
    any_of: tuple[tuple[Predicate, ...], ...] = ()  # OR of ANDs
    required: tuple[str, ...] = ()
    basis: str = "none"  # none, reference_date or field
    basis_field: str | None = None
    effective_from: dt.date | None = None
    effective_to: dt.date | None = None
    overrides: tuple[str, ...] = ()
    claims: tuple[Claim, ...] = ()
    topics: tuple[str, ...] = ()

    def __post_init__(self):
        if (self.basis == "field") != (self.basis_field is not None):
            raise ValueError("a field basis names its field, no other basis does")


class Tables(dict):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, rows: dict[str, tuple[list, str]]):
        super().__init__()
        self.spark, self.rows = spark, rows

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.createDataFrame(*self.rows[name])
        return self[name]

    def small(self, name: str) -> DataFrame:
        """The table, with a broadcast hint if its rows are no more than SMALL_ROWS: they are on the driver, so their number is known."""
        return F.broadcast(self[name]) if len(self.rows[name][0]) <= SMALL_ROWS else self[name]


@dataclass(frozen=True)
class Contract:
    units: tuple[Unit, ...] = ()
    fields: tuple[dict, ...] = ()
    definitions: tuple[dict, ...] = ()  # units of measure
    topics: tuple[dict, ...] = ()
    documents: tuple[dict, ...] = ()
    warnings: tuple[dict, ...] = ()

    @classmethod
    def from_body(cls, body: dict) -> Contract:
        """A contract from its JSON; what is missing or of the wrong shape raises ValueError, KeyError or TypeError."""
        day = lambda x: None if x is None else dt.date.fromisoformat(x)
        predicate = lambda p: Predicate(p["field_id"], p["operator"], tuple(map(Value.from_json, p.get("values", ()))), p.get("related_field_id"))

        def claim(c: dict) -> Claim:
            return Claim(c["claim_id"], c["canonical_text"], tuple(map(Value.from_json, c.get("normalized_literals", ()))), tuple(c["evidence_ids"]), tuple(c.get("qualifiers", ())), tuple(c.get("required_companion_claim_ids", ())))

        units = tuple(
            Unit(
                u["unit_id"], u["family_id"], tuple(tuple(map(predicate, g["all"])) for g in u.get("applicability_any", ())), tuple(u.get("required_field_ids", ())), u["time_basis"]["kind"], u["time_basis"]["field_id"],
                day(u["effective_from"]), day(u["effective_to"]), tuple(u.get("overrides_unit_ids", ())), tuple(map(claim, u["claims"])), tuple(u.get("topic_ids", ())),
            )
            for u in body["policy_units"]
        )
        documents = tuple(d | {k: day(d[k]) for k in ("effective_from", "effective_to")} for d in body["documents"])
        return cls(units, tuple(body["fields"]), tuple(body["units"]), tuple(body["scope"]), documents, tuple(body["warnings"]))

    def amounts(self) -> list[tuple[str, list[str], str]]:
        """The units of measure as rulewright.functions.text.literals takes them; a name also stands with 个 before it."""
        return [(d["unit_code"], [d["display_name"], "个" + d["display_name"], *d.get("aliases", ())], d["dimension"]) for d in self.definitions]

    def object_ids(self, spark: SparkSession, blocks: DataFrame) -> DataFrame:
        """Column object_id: the ids that may be told of a failure: those of the contract's objects and of its evidence."""
        ids = {d[k] for rows, k in ((self.documents, "document_id"), (self.topics, "topic_id"), (self.fields, "field_id"), (self.definitions, "unit_code")) for d in rows}
        ids |= {x for u in self.units for x in (u.unit_id, u.family_id, *(c.claim_id for c in u.claims))}
        return spark.createDataFrame([(x,) for x in sorted(ids)], "object_id string").unionByName(blocks.select(F.col("block_id").alias("object_id")))

    def all_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """tables(), each of them made."""
        made = self.tables(spark)
        return {name: made[name] for name in made.rows}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The contract as small tables, each with the rows' order where it matters."""
        unit_rows, predicate_rows, required, edges, claims, companions, evidence, literals, qualifiers, topics = ([] for _ in range(10))
        for i, u in enumerate(self.units):
            unit_rows.append((u.unit_id, u.family_id, u.basis, u.basis_field, u.effective_from, u.effective_to, len(u.any_of), i))
            required += [(u.unit_id, f) for f in u.required]
            edges += [(u.unit_id, t, i, j) for j, t in enumerate(u.overrides)]
            topics += [(u.unit_id, t) for t in u.topics]
            for g, group in enumerate(u.any_of):
                predicate_rows += [(u.unit_id, g, p, x.field_id, x.operator, x.related_field_id, [v.row() for v in x.values]) for p, x in enumerate(group)]
            for c in u.claims:
                claims.append((c.claim_id, u.unit_id, u.family_id, c.canonical_text))
                companions += [(c.claim_id, x) for x in c.companions]
                evidence += [(c.claim_id, x) for x in c.evidence_ids]
                literals += [(c.claim_id, v.kind, v.row()[-1], v.unit_code) for v in c.literals]
                qualifiers += [(c.claim_id, x) for x in c.qualifiers]
        make = lambda rows, schema: (rows, schema)
        bound = [(kind, d[key], e) for kind, key, rows in (("topic", "topic_id", self.topics), ("field", "field_id", self.fields), ("unit", "unit_code", self.definitions), ("warning", "code", self.warnings)) for d in rows for e in d.get("evidence_ids", ())]
        owners = [(kind, d[key]) for kind, key, rows in (("topic", "topic_id", self.topics), ("field", "field_id", self.fields), ("unit", "unit_code", self.definitions)) for d in rows]
        return Tables(spark, {
            "owners": make(owners + [("claim", c[0]) for c in claims], "kind string, owner_id string"),
            "owner_evidence": make(bound + [("claim", *e) for e in evidence], "kind string, owner_id string, block_id string"),
            "fields": make([(f["field_id"], f["display_name"], f["value_kind"], list(f.get("aliases", ())), i) for i, f in enumerate(self.fields)], "field_id string, display_name string, value_kind string, aliases array<string>, pos int"),
            "enum_options": make([(f["field_id"], o["code"], o["display_name"], list(o.get("aliases", ()))) for f in self.fields for o in f.get("allowed_values", ())], "field_id string, code string, display_name string, aliases array<string>"),
            "definitions": make([(d["unit_code"], d["display_name"], list(d.get("aliases", ())), d["dimension"], i) for i, d in enumerate(self.definitions)], "unit_code string, display_name string, aliases array<string>, dimension string, pos int"),
            "topics": make([(t["topic_id"], t["disposition"]) for t in self.topics], "topic_id string, disposition string"),
            "documents": make([(d["document_id"], d.get("effective_from"), d.get("effective_to")) for d in self.documents], "document_id string, effective_from date, effective_to date"),
            "warnings": make([(w["code"], w["severity"]) for w in self.warnings], "code string, severity string"),
            "units": make(unit_rows, "unit_id string, family_id string, basis string, basis_field string, effective_from date, effective_to date, n_groups int, pos int"),
            "predicates": make(predicate_rows, f"unit_id string, group_no int, pred_no int, field_id string, operator string, related_field_id string, values array<{VALUE}>"),
            "programs": make([
                (u.unit_id, u.basis, u.basis_field, u.effective_from, u.effective_to, [[(p.field_id, p.operator, p.related_field_id, [v.row() for v in p.values]) for p in g] for g in u.any_of], list(u.required), list(u.overrides), [c.claim_id for c in u.claims]) for u in self.units
            ], f"unit_id string, basis string, basis_field string, effective_from date, effective_to date, groups array<array<struct<field_id:string,operator:string,related_field_id:string,values:array<{VALUE}>>>>, required array<string>, targets array<string>, claims array<string>"),
            "required": make(required, "unit_id string, field_id string"),
            "overrides": make(edges, "unit_id string, target string, unit_pos int, own_pos int"),
            "unit_topics": make(topics, "unit_id string, topic_id string"),
            "claims": make(claims, "claim_id string, unit_id string, family_id string, canonical_text string"),
            "companions": make(companions, "claim_id string, companion_id string"),
            "claim_evidence": make(evidence, "claim_id string, block_id string"),
            "claim_literals": make(literals, "claim_id string, kind string, raw string, unit_code string"),
            "claim_qualifiers": make(qualifiers, "claim_id string, qualifier string"),
        })
