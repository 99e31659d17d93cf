"""Many quotes looked up in many texts at once: an automaton over all quotes reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.session import ship

#: UTF-8 bytes of quotes that one automaton holds. More quotes are dealt into several, each of which reads the texts once.
AUTOMATON_BYTES = 8 << 20
_FOUND = "number int, at long"


def _first_places(text: str, automaton: ahocorasick.Automaton) -> dict[int, int]:
    """The first place, from 1, of each quote that is in the text, by the quote's number."""
    out: dict[int, int] = {}
    for end, (number, length) in automaton.iter(text):
        out.setdefault(number, end - length + 2)
    return out


def find(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Columns of text_id and quote_id, at: where each quote stands first in each text that holds it, from 1. texts: text_id, text; quotes: quote_id, fragment. Empty quotes and NULLs are nowhere.

    Equal quotes are looked up once. Their size is summed first: what fits into one automaton goes to every task, more quotes are dealt by hash into parts of such a size, and
    every part is matched for itself, so that neither the driver nor a task holds more than one part.
    """
    spark = texts.sparkSession
    ship(spark)
    fragments = quotes.filter("fragment <> ''").select("fragment").distinct()
    size = fragments.agg(F.sum(F.octet_length("fragment"))).first()[0] or 0
    parts = size // limit + 1
    out = None
    for part in range(parts):
        own = fragments.filter(F.pmod(F.xxhash64("fragment"), F.lit(parts)) == part)
        held = sorted(r["fragment"] for r in own.collect())  # at most about limit bytes
        shared = spark.sparkContext.broadcast(held)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for i, q in enumerate(shared.value):
                automaton.add_word(q, (i, len(q)))
            automaton.make_automaton()
            for b in batches:
                rows, numbers, places = [], [], []
                for i, text in enumerate(b.column(1).to_pylist() if len(automaton) else ()):
                    found = _first_places(text or "", automaton)
                    rows += [i] * len(found)
                    numbers += found.keys()
                    places += found.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(places, pa.int64())], names=[text_id, "number", "at"])

        kind = texts.schema[text_id].dataType.simpleString()
        met = texts.select(text_id, "text").mapInArrow(match, f"{text_id} {kind}, {_FOUND}")
        names = spark.createDataFrame(list(enumerate(held)), "number int, fragment string")
        found = met.join(names, "number").join(quotes.select(quote_id, "fragment"), "fragment").select(text_id, quote_id, "at")
        out = found if out is None else out.unionByName(found)
    return out
