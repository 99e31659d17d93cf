"""Consistency checks of contracts, one or any number of them: each is a small query over tables with contract_id; the results are united and each kept once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions import text as T
from rulewright.functions.values import canonical
from rulewright.operators import graphs, intervals
from rulewright.plans.contract import Contract
from rulewright.session import by_sort, deal, materialize

_WINDOW = "within_natural_days_from_next_day"
_AMOUNTS = "kind in ('duration', 'money', 'quantity')"
#: Fixed: the code for what an evidence owner lacks, the deadline that a claim may promise, and a shared cause with its effects.
_DEADLINE = r"次日起\s*([0-9]+)\s*个自然日内.*?申请"
_CAUSE = r"因([^，。；;\n]{2,12}?)造成([^，。；;\n]+)"


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unit_names(definitions: DataFrame) -> DataFrame:
    """Columns contract_id, name, unit_code, kind, pos: every name of a unit of measure in compatible form; a name also stands with 个 before it."""
    named = definitions.select("contract_id", "unit_code", "pos", "dimension", F.explode(F.concat(F.array("display_name", F.concat(F.lit("个"), "display_name")), "aliases")).alias("alias"))
    kind = F.when(F.col("dimension").isin("duration", "money"), F.col("dimension")).otherwise("quantity")
    return named.select("contract_id", T.compatible("alias").alias("name"), "unit_code", kind.alias("kind"), "pos").distinct()


def ambiguous_names(names: DataFrame) -> DataFrame:
    """Columns contract_id, object_ids: names of several definitions of a contract, with the codes in the order of the definitions."""
    owners = names.groupBy("contract_id", "name").agg(F.array_sort(F.collect_set(F.struct("pos", "unit_code"))).alias("o")).filter(F.size("o") > 1)
    return owners.select("contract_id", F.concat(F.array("name"), F.col("o.unit_code")).alias("object_ids"))


def alias_verdicts(asked: DataFrame, options: DataFrame) -> DataFrame:
    """Columns owner, alias, verdict of aliases that are asked for (owner, alias): no change where the owner has it, conflict where another has, else new. options: owner, alias."""
    owners = options.groupBy("alias").agg(F.collect_set("owner").alias("owners"))
    verdict = F.when(F.array_contains("owners", F.col("owner")), "no change").when(F.col("owners").isNotNull(), "conflict").otherwise("new")
    return asked.join(owners, "alias", "left").select("owner", "alias", verdict.alias("verdict"))


def check(contract: Contract, blocks: DataFrame, source_documents: DataFrame, codes: frozenset[str] | None = None) -> DataFrame:
    """Columns code, object_ids (array): every defect of one contract against its evidence (blocks: block_id, text) and its sources (document_id), each once. With codes only these are looked for."""
    tables = {name: rows.withColumn("contract_id", F.lit(0)) for name, rows in contract.all_tables(blocks.sparkSession).items()}
    own = lambda rows: rows.withColumn("contract_id", F.lit(0))
    return check_tables(tables, own(blocks), own(source_documents), codes).drop("contract_id")


def check_tables(t: dict[str, DataFrame], blocks: DataFrame, source_documents: DataFrame, codes: frozenset[str] | None = None) -> DataFrame:
    """Columns contract_id, code, object_ids (array): every defect of every contract, each once. With codes only these are looked for, and nothing is planned for others.

    t: tables of contracts, each with contract_id (contract_tables.tables()); blocks: contract_id, block_id, text; source_documents: contract_id, document_id. A check is a
    join or an aggregate by contract_id and what it looks up, so contracts are dealt over all tasks. A contract with an ambiguous name of a unit has its
    amounts left unchecked.
    """
    wanted = [(code, rows) for code, rows in _checks(t, blocks, source_documents) if codes is None or code in codes]
    found = [rows().select("contract_id", F.lit(code).alias("code"), "object_ids") for code, rows in wanted]
    none = blocks.select("contract_id", F.lit("").alias("code"), F.array().cast("array<string>").alias("object_ids")).limit(0)
    return reduce(DataFrame.unionByName, found, none).distinct()


def _objects(rows: DataFrame, *objects: str | Column) -> DataFrame:
    return rows.select("contract_id", F.array(*[F.coalesce(F.col(o) if isinstance(o, str) else o, F.lit("")) for o in objects]).cast("array<string>").alias("object_ids"))


def _absent(rows: DataFrame, other: DataFrame, key: str, as_: str) -> DataFrame:
    """The rows whose key of their contract is not among the other's."""
    return rows.join(by_sort(other.select("contract_id", F.col(key).alias(as_)).distinct()), ["contract_id", as_], "left_anti")


def _checks(t: dict[str, DataFrame], blocks: DataFrame, source_documents: DataFrame) -> Iterator[tuple[str, Callable[[], DataFrame]]]:
    """Codes with what finds them, rows of contract_id and object_ids; a frame is made when it is asked for."""
    units, fields, claims, predicates, options, definitions = (t[k] for k in ("units", "fields", "claims", "predicates", "enum_options", "definitions"))
    k = "contract_id"
    # identities and scope
    for rows, key in ((t["documents"], "document_id"), (t["topics"], "topic_id"), (fields, "field_id"), (definitions, "unit_code"), (units, "unit_id"), (claims, "claim_id")):
        yield "DUPLICATE_ID", lambda rows=rows, key=key: _objects(duplicates(rows, k, key), key)
    yield "AMBIGUOUS_UNIT_ALIAS", lambda: ambiguous_names(unit_names(definitions))
    yield "COVERED_TOPIC_WITHOUT_UNIT", lambda: _objects(_absent(t["topics"].filter("disposition = 'covered'"), t["unit_topics"], "topic_id", "topic_id"), "topic_id")
    yield "UNKNOWN_DOCUMENT", lambda: _objects(_absent(t["documents"], source_documents, "document_id", "document_id"), "document_id")
    yield "INVALID_DATE_RANGE", lambda: _objects(t["documents"].filter("effective_from > effective_to"), "document_id")
    yield "INVALID_DATE_RANGE", lambda: _objects(units.filter("effective_from > effective_to"), "unit_id")
    yield "UNKNOWN_TOPIC", lambda: _objects(_absent(t["unit_topics"], t["topics"], "topic_id", "topic_id"), "unit_id", "topic_id")
    # evidence
    yield "UNBOUND_EVIDENCE", lambda: _objects(t["owners"].join(by_sort(t["owner_evidence"]), [k, "kind", "owner_id"], "left_anti"), "owner_id")
    yield "UNKNOWN_EVIDENCE", lambda: _objects(_absent(t["owner_evidence"], blocks, "block_id", "block_id"), "owner_id", "block_id")
    yield from _amount_checks(t, blocks)
    # fields
    label = F.exists(F.concat(F.array("display_name"), "aliases"), lambda x: x.rlike("[、或]"))
    yield "COMPOSITE_BOOLEAN_REASONS", lambda: _objects(fields.filter("value_kind = 'boolean'").filter(label).join(by_sort(predicates), [k, "field_id"], "left_semi"), "field_id")
    counted = lambda: fields.join(by_sort(options.groupBy(k, "field_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))), [k, "field_id"], "left")
    yield "INVALID_ENUM_DEFINITION", lambda: _objects(counted().filter("(value_kind = 'enum' and (n is null or codes < n)) or (value_kind <> 'enum' and n is not null)"), "field_id")
    aliased = lambda: options.withColumn("alias", F.explode("aliases")).select(k, "field_id", "code", T.nfkc_surface("display_name").alias("shown"), T.nfkc_surface("alias").alias("alias"))
    yield "UNSAFE_ENUM_QUALIFIER_ALIAS", lambda: _objects(aliased().filter("contains(shown, '未经授权') and not contains(alias, '未经授权')"), "field_id", "code")
    yield from _condition_checks(t)
    # overrides and versions
    family = units.select(k, F.col("unit_id").alias("target"), F.col("family_id").alias("target_family"))
    edges = lambda: t["overrides"].join(by_sort(units.select(k, "unit_id", "family_id")), [k, "unit_id"]).join(by_sort(family), [k, "target"], "left")
    yield "UNKNOWN_OVERRIDE", lambda: _objects(edges().filter("target_family is null"), "unit_id", "target")
    yield "CROSS_FAMILY_OVERRIDE", lambda: _objects(edges().filter("target_family <> family_id"), "unit_id", "target")
    known = lambda: t["overrides"].join(by_sort(family.select(k, "target").distinct()), [k, "target"], "left_semi")
    yield "OVERRIDE_CYCLE", lambda: graphs.cycles(known(), "unit_id", "target", [k], ["unit_pos", "own_pos"]).select(k, F.col("path").alias("object_ids"))
    yield "OVERLAPPING_VERSIONS", lambda: _objects(unlinked_versions(units, t["overrides"]), "left_unit_id", "right_unit_id")
    yield from _claim_checks(t, blocks)
    # warnings
    yield "UNSUPPORTED_CONDITION", lambda: _objects(t["warnings"].filter("startswith(code, 'UNSUPPORTED_')"), "code")
    yield "BLOCKING_WARNING", lambda: _objects(t["warnings"].filter("severity = 'blocking'"), "code")


def unlinked_versions(units: DataFrame, overrides: DataFrame) -> DataFrame:
    """Columns contract_id, family_id, left_unit_id, right_unit_id: versions of a family that share a day, of which neither overrides the other."""
    pairs = intervals.overlapping(units, ["contract_id", "family_id"], "pos", ["unit_id"], "effective_from", "effective_to")
    linked = overrides.select("contract_id", F.col("unit_id").alias("left_unit_id"), F.col("target").alias("right_unit_id"))
    return pairs.join(by_sort(linked.unionAll(linked.select("contract_id", "right_unit_id", "left_unit_id"))), ["contract_id", "left_unit_id", "right_unit_id"], "left_anti")


def _amount_checks(t: dict[str, DataFrame], blocks: DataFrame) -> Iterator[tuple[str, Callable[[], DataFrame]]]:
    """Amounts in the evidence, in the claims' texts and in their annotations, by the names of each contract; numbers of any length."""
    k, columns = "contract_id", ["contract_id", "claim_id", "kind", "number", "unit_code"]

    def found(rows: DataFrame, key: str, column: str) -> DataFrame:
        names = unit_names(t["definitions"])
        clear = names.join(by_sort(ambiguous_names(names).select(k)), k, "left_anti").groupBy(k).agg(F.collect_set(F.struct("name", "unit_code", "kind")).alias("names"))
        texts = deal(rows, k).join(by_sort(clear), k)
        return texts.select(k, key, F.explode(T.literals_by(F.col(column), F.col("names"))).alias("x")).select(k, key, "x.kind", canonical(F.col("x.raw")).alias("number"), "x.unit_code").distinct()

    @cache
    def said() -> DataFrame:
        """Written once, as both checks use it."""
        return materialize(found(t["claims"], "claim_id", "canonical_text"), "said")

    def unclaimed() -> DataFrame:
        shown = found(blocks, "block_id", "text")
        backed = shown.join(by_sort(t["claim_evidence"].join(by_sort(said()), [k, "claim_id"])), [k, "block_id", "kind", "number", "unit_code"], "left_semi").select(k, "block_id").distinct()
        return _objects(shown.select(k, "block_id").distinct().join(by_sort(backed), [k, "block_id"], "left_anti"), "block_id")

    def misnoted() -> DataFrame:
        unclear = ambiguous_names(unit_names(t["definitions"])).select(k)
        noted = t["claim_literals"].filter(_AMOUNTS).join(by_sort(unclear), k, "left_anti").withColumn("number", canonical(F.col("raw"))).select(*columns).distinct()
        one_side = said().select(*columns).unionAll(noted).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")  # each side has each but once
        return _objects(one_side.select(k, "claim_id").distinct(), "claim_id")

    yield "NUMERIC_EVIDENCE_WITHOUT_CLAIM", unclaimed
    yield "CLAIM_LITERAL_MISMATCH", misnoted


def _condition_checks(t: dict[str, DataFrame]) -> Iterator[tuple[str, Callable[[], DataFrame]]]:
    units, fields, predicates, definitions, k = t["units"], t["fields"], t["predicates"], t["definitions"], "contract_id"
    known = fields.select(k, "field_id", "value_kind")
    yield "UNKNOWN_FIELD", lambda: _objects(_absent(t["required"].unionByName(predicates.select(k, "unit_id", "field_id")), fields, "field_id", "field_id"), "unit_id", "field_id")

    def unguarded() -> DataFrame:
        """Claims that promise a deadline, of units with a group of conditions that has no window of as many days."""
        promised = t["claims"].select(k, "unit_id", "claim_id", canonical(F.nullif(F.regexp_extract(T.nfkc_surface("canonical_text"), _DEADLINE, 1), F.lit(""))).alias("days")).filter("days is not null").join(by_sort(units.select(k, "unit_id", "n_groups")), [k, "unit_id"])
        windows = predicates.filter(F.col("operator") == _WINDOW).select(k, "unit_id", "group_no", canonical(F.get("values", F.lit(0))["raw"]).alias("days")).distinct()
        guarded = promised.join(by_sort(windows), [k, "unit_id", "days"], "left").groupBy(k, "unit_id", "claim_id", "n_groups").agg(F.countDistinct("group_no").alias("guarded"))
        return _objects(guarded.filter("n_groups = 0 or guarded < n_groups"), "unit_id", "claim_id")

    yield "UNGUARDED_RELATIVE_DEADLINE", unguarded
    evidenced = t["owner_evidence"].filter("kind = 'field'").select(k, F.col("owner_id").alias("field_id")).distinct().withColumn("evidenced", F.lit(True))
    based = units.filter("basis = 'field'").select(k, "unit_id", F.col("basis_field").alias("field_id"), "effective_from")
    yield "INVALID_TIME_BASIS", lambda: _objects(based.join(by_sort(known.join(by_sort(evidenced), [k, "field_id"], "left_semi")), [k, "field_id"], "left_anti"), "unit_id", "field_id")
    before = predicates.filter("operator = 'before'").select(k, "unit_id", "field_id", F.get("values", F.lit(0)).alias("v"))
    yield "UNSATISFIABLE_TIME_BASIS", lambda: _objects(based.join(by_sort(before), [k, "unit_id", "field_id"]).filter("v.kind = 'date' and v.d <= effective_from"), "unit_id", "field_id")
    yield "OPTIONAL_GUARD_REQUIRED", lambda: _objects(predicates.filter("operator = 'not_before_if_present'").join(by_sort(t["required"]), [k, "unit_id", "field_id"], "left_semi"), "unit_id", "field_id")
    used = predicates.join(by_sort(known), [k, "field_id"])

    def odd_windows() -> DataFrame:
        """Windows of days that aren't between two evidenced dates, or not in a unit of days by that name."""
        other = known.join(by_sort(evidenced), [k, "field_id"], "left").select(k, F.col("field_id").alias("related_field_id"), F.col("value_kind").alias("related_kind"), "evidenced")
        natural = definitions.select(k, "unit_code", "dimension", F.explode(F.concat(F.array("display_name"), "aliases")).alias("name")).groupBy(k, "unit_code", "dimension").agg(F.bool_or(T.nfkc_surface("name") == "自然日").alias("natural"))
        days = used.filter(F.col("operator") == _WINDOW).withColumn("unit_code", F.get("values", F.lit(0))["unit_code"]).join(by_sort(other), [k, "related_field_id"], "left").join(by_sort(natural), [k, "unit_code"], "left")
        good = (F.col("value_kind") == "date") & (F.col("related_kind") == "date") & F.col("evidenced") & (F.col("dimension") == "duration") & F.col("natural")
        return _objects(days.filter(~F.coalesce(good, F.lit(False))), "unit_id", "field_id", "related_field_id")

    yield "INVALID_RELATIVE_DATE_PREDICATE", odd_windows
    compared = used.filter(F.col("operator") != _WINDOW)
    each = compared.select(k, "unit_id", "field_id", "value_kind", F.explode("values").alias("v"))
    yield "FIELD_KIND_CONFLICT", lambda: _objects(each.filter("v.kind <> value_kind"), "unit_id", "field_id")
    codes = t["enum_options"].select(k, "field_id", "code").distinct()
    yield "UNKNOWN_ENUM_VALUE", lambda: _objects(each.filter("v.kind = 'enum'").select(k, "unit_id", "field_id", F.col("v.s").alias("code")).join(by_sort(codes), [k, "field_id", "code"], "left_anti"), "unit_id", "field_id")
    yield "INVALID_DATE_RANGE", lambda: _objects(compared.filter("operator = 'between' and coalesce(get(values, 0).d > get(values, 1).d, get(values, 0).ts > get(values, 1).ts)"), "unit_id", "field_id")


def _claim_checks(t: dict[str, DataFrame], blocks: DataFrame) -> Iterator[tuple[str, Callable[[], DataFrame]]]:
    k = "contract_id"
    cited = t["claim_evidence"].join(by_sort(blocks), [k, "block_id"]).select(k, "claim_id", "block_id", T.nfkc_surface("text").alias("source"))
    plain = t["claims"].select(k, "claim_id", T.nfkc_surface("canonical_text").alias("surface"))

    def lost_causes() -> DataFrame:
        part = lambda i: F.regexp_extract_all("source", F.lit(_CAUSE), F.lit(i))
        cause = cited.join(by_sort(plain), [k, "claim_id"]).select(k, "claim_id", "surface", F.explode(F.arrays_zip(part(1).alias("cause"), part(2).alias("effects"))).alias("x"))
        effects = F.transform(F.split("x.effects", "[、或]"), lambda e: F.split(F.regexp_replace(e, r"^(?U)\s+|\s+$", ""), "的")[0])
        lost = F.exists(effects, lambda e: (F.length(e) >= 2) & F.contains(F.col("surface"), e)) & ~F.contains(F.col("surface"), F.col("x.cause"))
        return _objects(cause.filter(lost), "claim_id")

    yield "LOST_CAUSAL_QUALIFIER", lost_causes
    qualified = t["claim_qualifiers"].select(k, "claim_id", T.nfkc_surface("qualifier").alias("q"))
    yield "CLAIM_QUALIFIER_NOT_CANONICAL", lambda: _objects(qualified.join(by_sort(plain), [k, "claim_id"]).filter("q = '' or not contains(surface, q)"), "claim_id")
    held = qualified.join(by_sort(cited), [k, "claim_id"]).filter("q <> '' and contains(source, q)").select(k, "claim_id", "q")
    yield "CLAIM_QUALIFIER_NOT_EVIDENCED", lambda: _objects(qualified.join(by_sort(held), [k, "claim_id", "q"], "left_anti"), "claim_id")
    yield "UNKNOWN_COMPANION", lambda: _objects(_absent(t["companions"], t["claims"], "claim_id", "companion_id"), "claim_id", "companion_id")
    measured = t["claim_literals"].filter(_AMOUNTS).join(by_sort(t["definitions"].select(k, "unit_code", "dimension")), [k, "unit_code"], "left")
    yield "UNKNOWN_UNIT", lambda: _objects(measured.filter("dimension is null"), "claim_id", "unit_code")
    yield "UNIT_KIND_CONFLICT", lambda: _objects(measured.filter("dimension <> kind"), "claim_id", "unit_code")
