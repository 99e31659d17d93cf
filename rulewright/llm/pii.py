"""Personal data: base patterns, and terms that disclose them by the information that they carry over the corpus. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import materialize, with_row_ids

#: Kinds of span, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed: what a base span looks like. Each is equal to the plain pattern with its checks of length, but never tries again within a run of characters that it has read.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD_END = r"[^\p{L}\p{N}_]+"
#: Characters on either side of a base span, and words of them, that are its context.
CONTEXT_CHARS, CONTEXT_WORDS = 120, 8
#: A term: a word of two characters or more with a letter in it, or a number of four digits or more.
_TERM = r"^(?:(?=.*\p{L})[\p{L}\p{N}_]{2,}|\p{N}{4,})$"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the check sum of the digits is right: from the right, every second one counts twice, less 9 if over 9."""

    def worth(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _located(text: Column, pattern: Column, hits: Column, kind: int) -> Column:
    """The hits as spans of code points: each starts after the gaps up to it and the hits before it."""
    gaps = F.split(text, pattern, -1)
    length = lambda s, x: s + F.length(x)

    def span(value: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), length) + F.aggregate(F.slice(hits, F.lit(1), i), F.lit(0), length)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    return F.when(F.size(hits) > 0, F.transform(hits, span)).otherwise(F.array().cast(_SPAN))


def base_spans(rows: DataFrame) -> DataFrame:
    """rows (with a column text, never null) and base: its valid base spans, by kind, then start."""
    hits = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    held = rows.select("*", *[(F.when(guards[k], h).otherwise(none) if k in guards else h).alias(f"hits_{k}") for k, h in hits.items()])
    spans = [_checked(k, _located(F.col("text"), F.lit(p), F.col(f"hits_{k}"), KINDS.index(k))) for k, p in PATTERNS.items()]
    return held.select(*rows.columns, F.concat(*spans).alias("base"))


def _entity(span: Column) -> Column:
    """What a base span stands for, however it is written."""
    value = F.when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD_END), lambda w: w.rlike(_TERM))


def disclosing_terms(rows: DataFrame, located: DataFrame, threshold: float, prior: float, least: float) -> DataFrame:
    """Columns term, disclosure, wide: the terms that disclose some entity, and whether each occurs outside that entity's contexts too.

    rows: uid, text of all documents; located: uid, text, base of them. A term discloses an entity by its pointwise mutual information with it, as a share of the entity's own information: 1 + log(p) / log(N / n(e)), where N and n(e) are numbers
    of documents, and p estimates the share of the term's documents that speak of the entity: the different contexts in which documents have both, out of all documents with the term,
    smoothed by `prior` documents more of which n(e) / N do. Equal contexts are one witness however many documents copy them, and each copy counts against the term.
    p must be `least` at least: a term that occurs apart from the entity more often than with it tells little of it, however rare both are. A value that is seen once has disclosing terms, those seen nowhere else, if the corpus is large enough for that to be no chance.
    """
    spans = located.filter(F.size("base") > 0).select("uid", "text", F.explode("base").alias("span"))
    before = F.substring("text", F.greatest(F.col("span.start") - CONTEXT_CHARS, F.lit(0)) + 1, F.least(F.col("span.start"), F.lit(CONTEXT_CHARS)))
    after = F.substring("text", F.col("span.end") + 1, F.lit(CONTEXT_CHARS))
    left, right = F.split(F.lower(before), _WORD_END), F.split(F.lower(after), _WORD_END)
    # the outermost word may be cut off
    left = F.when(F.size(left) > CONTEXT_WORDS + 1, F.slice(left, -(CONTEXT_WORDS + 1), CONTEXT_WORDS + 1)).otherwise(left)
    near = spans.select("uid", _entity(F.col("span")).alias("entity"), F.concat(left, F.slice(right, 1, CONTEXT_WORDS + 1)).alias("words"))
    near = near.select("uid", "entity", F.xxhash64("words").alias("context"), F.filter("words", lambda w: w.rlike(_TERM)).alias("words"))
    seen = near.select("uid", "entity", "context", F.explode(F.array_distinct("words")).alias("term")).distinct()
    pairs = seen.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("uid").alias("both"))
    entities = near.groupBy("entity").agg(F.countDistinct("uid").alias("n_entity"))
    everywhere = rows.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = rows.select(F.count(F.lit(1)).alias("n"))
    known = pairs.join(entities, "entity").join(everywhere, "term").crossJoin(F.broadcast(total))  # total is one row
    own = F.log(F.col("n") / F.col("n_entity"))
    seen_in = F.least("contexts", "both").cast("double")  # several contexts of one document are one witness
    held = (seen_in + prior * F.col("n_entity") / F.col("n")) / (F.col("n_term") + prior)
    share = F.when(own > 0, 1 + F.log(held) / own).otherwise(F.lit(0.0))
    told = known.filter(held >= least).select("term", share.alias("disclosure"), (F.col("n_term") > F.col("both")).alias("wide")).filter(F.col("disclosure") >= threshold)
    return told.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.bool_and("wide").alias("wide"))


def _spans(rows: DataFrame, threshold: float, prior: float, least: float) -> DataFrame:
    """Columns uid, doc_id, base, terms: each row's base spans, and those of disclosing terms (value: the term's disclosure) that no base span touches."""
    located = base_spans(rows.select("uid", "doc_id", "text"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    # the texts of documents with spans are kept along with them, so that no other text is moved
    base = materialize(located.select("uid", "doc_id", plain.alias("base"), F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")
    near = base.filter(F.size("base") > 0).select("uid", "text", "base")
    terms = materialize(disclosing_terms(rows, near, threshold, prior, least), "terms")
    # terms that occur in their entity's documents only need not be looked for in all others
    has = lambda docs, terms: docs.select("uid", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(terms.drop("wide"), "term")
    holders = has(rows, terms.filter("wide")).unionAll(has(near, terms.filter("not wide"))).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    holders = materialize(holders, "holders")
    held = near.select("uid", "text").join(holders, "uid").unionAll(rows.select("uid", "text").join(holders.join(near.select("uid"), "uid", "left_anti"), "uid"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join(F.map_keys("known"), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    held = held.withColumn("pattern", pattern).withColumn("hits", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    found = held.select("uid", "known", _located(F.col("text"), F.col("pattern"), F.col("hits"), KINDS.index("term")).alias("terms"))
    found = found.select("uid", F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.col("known")[F.lower(s["value"])].cast("string").alias("value"))).alias("terms"))
    both = base.drop("text").join(found, "uid", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_SPAN)))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return both.select("uid", "doc_id", "base", apart.alias("terms"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, threshold: float = 0.9, prior: float = 0.75, least: float = 0.5) -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: a row for each row of docs (doc_id, text).

    Base spans are e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers. Over all documents, co-occurrence tells how
    strongly a term reveals one of these values; a term at or over the threshold (1: it tells all) is a span of kind term wherever it occurs, in whatever document. Base spans stay as they are; a term that touches one is
    dropped. Only documents that hold such a term meet it by a join.

    A null text is empty: no spans. Repeated rows and null doc_ids are rows of their own, and count as documents. Other columns are ignored; an empty table gives an empty result.
    """
    spans = _spans(with_row_ids(docs), threshold, prior, least)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    listed = _listed(F.col("base"))
    return spans.select("doc_id", *map(count, PATTERNS), F.sha2(listed, 256).alias("base_sha256"), _listed(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, *, threshold: float = 0.9, prior: float = 0.75, least: float = 0.5, remove_from: float = 0.99, **keep: str) -> DataFrame:
    """Columns doc_id, text and those of keep (name = "type"): docs with each span replaced.

    A base span is generalised to its kind in brackets. A term is generalised to [TERM], or removed if its disclosure is remove_from at
    least. Of spans that overlap the first stays, the longer of two at one place. Odd rows as in find.
    """
    rows = with_row_ids(docs, **keep)
    spans = _spans(rows, threshold, prior, least).filter((F.size("base") > 0) | (F.size("terms") > 0)).select("uid", F.concat("base", "terms").alias("spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    removed = lambda s: (s["kind"] == KINDS.index("term")) & (s["value"].cast("double") >= remove_from)
    sort_key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(removed(s), F.lit("")).otherwise(names[s["kind"]]).alias("put"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), s["put"])
        return F.when(s["start"] < state["at"], state).otherwise(F.struct((-s["back"]).alias("at"), kept.alias("out")))

    done = F.aggregate(F.array_sort(F.transform("spans", sort_key)), start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    joined = rows.join(spans, "uid", "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"), *keep)
