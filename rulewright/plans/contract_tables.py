"""Any number of contracts as tables: their JSON texts parsed once, and a table of each kind of object, all with contract_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import schemas
from rulewright.plans import records
from rulewright.plans.batch import typed
from rulewright.session import materialize

_IDS = "array<string>"
_VALUE = "struct<kind:string,value:string,unit_code:string>"
#: The parts of a contract that its checks use.
BODY = (
    f"documents array<struct<document_id:string,effective_from:date,effective_to:date>>, scope array<struct<topic_id:string,disposition:string,evidence_ids:{_IDS}>>, "
    f"fields array<struct<field_id:string,display_name:string,aliases:{_IDS},value_kind:string,allowed_values:array<struct<code:string,display_name:string,aliases:{_IDS}>>,evidence_ids:{_IDS}>>, "
    f"units array<struct<unit_code:string,display_name:string,aliases:{_IDS},dimension:string,evidence_ids:{_IDS}>>, "
    f"policy_units array<struct<unit_id:string,family_id:string,topic_ids:{_IDS},applicability_any:array<struct<all:array<struct<field_id:string,operator:string,related_field_id:string,values:array<{_VALUE}>>>>>,"
    f"required_field_ids:{_IDS},time_basis:struct<kind:string,field_id:string>,effective_from:date,effective_to:date,"
    f"claims:array<struct<claim_id:string,canonical_text:string,normalized_literals:array<{_VALUE}>,evidence_ids:{_IDS},qualifiers:{_IDS},required_companion_claim_ids:{_IDS}>>,overrides_unit_ids:{_IDS}>>, "
    f"warnings array<struct<code:string,severity:string,evidence_ids:{_IDS}>>"
)


def parse(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of contracts (contract_id, body: JSON): those that keep the schema (contract_id, b), written once, and the faults of the others (contract_id, faults)."""
    checked = materialize(contracts.select("contract_id", schemas.check(F.col("body"), records.CONTRACT).alias("faults"), F.from_json("body", BODY, {"dateFormat": "yyyy-MM-dd"}).alias("b")), "contracts")
    return checked.filter(F.size("faults") == 0).select("contract_id", "b"), checked.filter(F.size("faults") > 0).select("contract_id", "faults")


def _list(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast(_IDS))


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of Contract.tables() for all contracts at once, each with contract_id."""
    k = "contract_id"
    each = lambda part, *columns: parsed.select(k, F.posexplode(f"b.{part}").alias("pos", "x")).select(k, *columns)
    x = lambda name: F.col(f"x.{name}")
    unit = each("policy_units", "pos", "x")
    of_unit = lambda part, *columns: unit.select(k, x("unit_id").alias("unit_id"), x("family_id").alias("family_id"), "pos", F.posexplode(x(part)).alias("own_pos", "y")).select(k, *columns)
    claim = of_unit("claims", "unit_id", "family_id", F.col("y").alias("c"))
    of_claim = lambda part, *columns: claim.select(k, F.col("c.claim_id").alias("claim_id"), F.explode(f"c.{part}").alias("y")).select(k, "claim_id", *columns)
    group = of_unit("applicability_any", "unit_id", F.col("own_pos").alias("group_no"), F.col("y.all").alias("all")).select(k, "unit_id", "group_no", F.posexplode("all").alias("pred_no", "p"))
    owned = [each(part, F.lit(kind).alias("kind"), x(key).alias("owner_id"), _list(x("evidence_ids")).alias("ids")) for part, kind, key in (("scope", "topic", "topic_id"), ("fields", "field", "field_id"), ("units", "unit", "unit_code"), ("warnings", "warning", "code"))]
    owners = owned[0].unionByName(owned[1]).unionByName(owned[2]).unionByName(owned[3]).unionByName(claim.select(k, F.lit("claim").alias("kind"), F.col("c.claim_id").alias("owner_id"), _list("c.evidence_ids").alias("ids")))
    return {
        "owners": owners.filter("kind <> 'warning'").select(k, "kind", "owner_id"),
        "owner_evidence": owners.select(k, "kind", "owner_id", F.explode("ids").alias("block_id")),
        "fields": each("fields", x("field_id").alias("field_id"), x("display_name").alias("display_name"), x("value_kind").alias("value_kind"), _list(x("aliases")).alias("aliases"), "pos"),
        "enum_options": each("fields", x("field_id").alias("field_id"), F.explode(x("allowed_values")).alias("o")).select(k, "field_id", "o.code", "o.display_name", _list("o.aliases").alias("aliases")),
        "definitions": each("units", x("unit_code").alias("unit_code"), x("display_name").alias("display_name"), _list(x("aliases")).alias("aliases"), x("dimension").alias("dimension"), "pos"),
        "topics": each("scope", x("topic_id").alias("topic_id"), x("disposition").alias("disposition")),
        "documents": each("documents", x("document_id").alias("document_id"), x("effective_from").alias("effective_from"), x("effective_to").alias("effective_to")),
        "warnings": each("warnings", x("code").alias("code"), x("severity").alias("severity")),
        "units": unit.select(k, x("unit_id").alias("unit_id"), x("family_id").alias("family_id"), x("time_basis.kind").alias("basis"), x("time_basis.field_id").alias("basis_field"), x("effective_from").alias("effective_from"), x("effective_to").alias("effective_to"), F.greatest(F.lit(0), F.coalesce(F.size(x("applicability_any")), F.lit(0))).alias("n_groups"), "pos"),
        "predicates": group.select(k, "unit_id", "group_no", "pred_no", "p.field_id", "p.operator", "p.related_field_id", F.coalesce(F.transform("p.values", typed), F.array()).alias("values")),
        "required": of_unit("required_field_ids", "unit_id", F.col("y").alias("field_id")),
        "overrides": of_unit("overrides_unit_ids", "unit_id", F.col("y").alias("target"), F.col("pos").alias("unit_pos"), "own_pos"),
        "unit_topics": of_unit("topic_ids", "unit_id", F.col("y").alias("topic_id")),
        "claims": claim.select(k, F.col("c.claim_id").alias("claim_id"), "unit_id", "family_id", F.col("c.canonical_text").alias("canonical_text")),
        "companions": of_claim("required_companion_claim_ids", F.col("y").alias("companion_id")),
        "claim_evidence": of_claim("evidence_ids", F.col("y").alias("block_id")),
        "claim_literals": of_claim("normalized_literals", F.col("y.kind").alias("kind"), F.col("y.value").alias("raw"), F.col("y.unit_code").alias("unit_code")),
        "claim_qualifiers": of_claim("qualifiers", F.col("y").alias("qualifier")),
    }
