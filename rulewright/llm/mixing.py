"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of words, and a cut at each source's exact budget; what a source lacks is taken in further passes over it.

A document's size is its number of words (longest stretches without ASCII white space; a null text has none). Sources in code point order, null
last, weigh 1, 2, 3 and so on in turn; they share the total of all sizes by weight. A source's target stops at `passes` times its size, and
what is above is shared by weight among the others until none is above: the level t with sum of min(passes * size, weight * t) = total, which is
found in one sorted pass over the sources. A source is taken whole as often as its budget (its target without the fraction) allows, then in
the order of the keys until the budget is met to the word: one document of each source may be cut.

Odd input: documents of size 0 are in the mix with 0 words; an empty table gives an empty mix. A null doc_id has a key as any other value has.
Rows of one doc_id and text are copies: which of them is taken is arbitrary, but how many are is not. Rows of one doc_id with different texts come
in the order of size and hash of the text. Other columns are not looked at. Reruns agree, however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import materialize, with_row_ids
from rulewright.operators.prefix import running

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source are joined to what is known of it in so many groups, as one source may hold a third of all rows.
SALTS = 32
SEED = 2024


def key(doc_id: Column, seed: int = SEED) -> Column:
    """A number of 60 bits that looks random, from doc_id alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[int], passes: int) -> DataFrame:
    """sizes: source, source_size, a row a source. Adds ahead (words of all sources before it) and target."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(sizes, by_name, {"ahead": F.col("source_size"), "place": F.lit(1)}, "sources")
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")).withColumn("limit", F.col("source_size") * passes)
    filling = running(weighed, [F.col("limit") / F.col("weight"), *by_name], {"limit_before": F.col("limit"), "weight_before": F.col("weight")}, "levels")
    total, weight = filling.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return filling.withColumn("target", F.lit(None).cast("double"))
    full = F.col("limit") / F.col("weight") <= (F.lit(total) - F.col("limit_before")) / (F.lit(weight) - F.col("weight_before"))
    stopped, their = filling.filter(full).agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (total - stopped) / (weight - their) if weight > their else 0.0
    return filling.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _plan(rows: DataFrame, weights: Sequence[int], passes: int, seed: int) -> DataFrame:
    text = F.col("text")
    narrow = rows.select("uid", "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key(F.col("doc_id"), seed).alias("key"), F.xxhash64(text).alias("mark"))
    narrow = materialize(narrow, "sizes")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("mark"), F.col("uid")]
    placed = running(narrow, order, {"words_before": F.col("size")}, "sorted")
    sources = materialize(_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes), "targets")
    dealt = sources.select(F.col("source").alias("_source"), "source_size", "ahead", "target", F.floor("target").cast("long").alias("budget"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = placed.withColumn("_at", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    place = F.col("words_before") - F.col("ahead")
    rest = F.col("budget") - F.col("passes") * F.col("source_size") - F.col("place")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    counted = joined.withColumn("passes", whole).withColumn("place", place)
    return counted.select("uid", "doc_id", "source", "size", "source_size", "target", "place", "passes", (F.col("passes") * F.col("size") + part).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = 3, seed: int = SEED) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, place, passes, taken: a row a document.

    place: words of its source before it in one pass; passes: how often the whole source is taken; taken: words the mix takes of it, repeats counted.
    weights: positive whole numbers. docs: doc_id, text, source; other columns don't matter.
    """
    return _plan(with_row_ids(docs, source="string"), weights, passes, seed)


def texts(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = 3, seed: int = SEED) -> DataFrame:
    """The mix itself: doc_id, source, pass (from 0), place, text; a document that the budget cuts ends with its last whole word.

    (pass, place) is the order within a source. Documents without words are not in it.
    """
    rows = with_row_ids(docs, source="string")
    plan = _plan(rows, weights, passes, seed).filter("taken > 0").select("uid", "size", "place", "taken")
    turns = rows.join(plan, "uid").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    left = F.col("taken") - F.col("pass") * F.col("size")
    cut = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), left.cast("int")))
    return turns.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "place", F.when(left < F.col("size"), cut).otherwise(F.col("text")).alias("text"))
