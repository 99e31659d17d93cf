"""What of a run may be logged: fixed codes, ids of the contract, counts of tokens; never a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import sanitised_code

#: Fixed: response states and counts that may be told.
STATES = ("completed", "incomplete", "failed", "cancelled")
USAGE = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens")
#: Fixed: what a probe asks for.
PROBE = 14


def failures(replies: DataFrame, issues: DataFrame, allowed: DataFrame) -> DataFrame:
    """Columns item_id, attempt, response_status, issue_codes, contract_object_ids and USAGE: one row for each failed reply (item_id, attempt, status, USAGE), even without issues.

    issues: item_id, attempt, code, object_ids; allowed: object_id, the ids of the contract. Other states are `other`, other codes UNSAFE_ISSUE_CODE, other ids are left out; codes and ids come once each and in order.
    """
    key = ["item_id", "attempt"]
    codes = issues.groupBy(*key).agg(F.array_sort(F.collect_set(sanitised_code(F.col("code")))).alias("issue_codes"))
    named = issues.select(*key, F.explode("object_ids").alias("object_id")).join(allowed.select("object_id").distinct(), "object_id", "left_semi")
    ids = named.groupBy(*key).agg(F.array_sort(F.collect_set("object_id")).alias("contract_object_ids"))
    none = F.array().cast("array<string>")
    state = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("other")
    told = replies.join(codes, key, "left").join(ids, key, "left")
    return told.select(*key, state.alias("response_status"), F.coalesce("issue_codes", none).alias("issue_codes"), F.coalesce("contract_object_ids", none).alias("contract_object_ids"), *USAGE)


def requests(replies: DataFrame) -> DataFrame:
    """Columns id, status, model, USAGE, elapsed_seconds, attempt of each reply."""
    return replies.select(F.col("response_id").alias("id"), "status", "model", *USAGE, "elapsed_seconds", "attempt")


def error_code(status: Column, name: Column) -> Column:
    """HTTP_ and the status of an error that has one, else its name."""
    return F.coalesce(F.concat(F.lit("HTTP_"), status.cast("string")), name)


def usage(replies: DataFrame, *key: str) -> DataFrame:
    """Columns of key, requests and USAGE: the number of replies and the sums of what was reported, NULL if nothing was."""
    return replies.groupBy(*key).agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in USAGE])


def probe_passed(status: Column, text: Column) -> Column:
    """Whether a probe's reply is complete and is just the object asked for."""
    parsed = F.try_parse_json(text)
    whole = (F.schema_of_variant(parsed) == "OBJECT<normalized: BIGINT>") & (F.try_variant_get(parsed, "$.normalized", "long") == PROBE)
    return F.coalesce((status == "completed") & whole, F.lit(False))
