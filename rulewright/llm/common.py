"""What the corpus operators share: column picking, batch limits, row ids, and tables in the shared folder."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.session import materialize, ship

#: Rows in one Arrow batch that goes to Python; long texts make a batch of 10,000 rows too large for a worker.
BATCH_ROWS = 1000
#: Text characters that a Python worker handles at once.
CHUNK_CHARS = 1 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package on its executors and Arrow batches bounded."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to a type, by position, so that other columns (of any name, even the same but for case) do not matter.

    columns: output name = "type" for the column of the same name, the first one if it repeats.
    """
    found = {}
    for name, kind in columns.items():
        at = next((i for i, c in enumerate(df.columns) if c == name), None)
        if at is None:
            at = next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)
        if at is None:
            raise ValueError(f"no column {name} among {df.columns}")
        found[name] = (at, kind)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at}").cast(kind).alias(name) for name, (at, kind) in found.items()])


def with_row_ids(docs: DataFrame, **keep: str) -> DataFrame:
    """Columns uid long (unique), doc_id long, text string (null: empty), and those of keep (name = "type").

    uid is doc_id where that is unique and never null; else the rows are written once with a number each.
    """
    rows = pick(docs, doc_id="long", text="string", **keep).withColumn("text", F.coalesce("text", F.lit("")))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("uid"), "*")
    return materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "rows")


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about limit characters; null is the empty text."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the values, cut to the lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the keys, from batches sorted by them; only the current run is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for i, j in itertools.pairwise(cuts):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined into tables of at least so many rows (the last one may have fewer), each column in one chunk."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows, from batches sorted by the key (never null); all rows of one key are in one table."""
    held: list[pa.RecordBatch] = []
    size, wanted = 0, rows
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            other = np.flatnonzero(keys != keys[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held, size = table.slice(cut).to_batches(), size - cut
            wanted = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Recent:
    """A bounded memory of what was worked out: two generations, of which the older goes when the younger is full."""

    def __init__(self, kept: int):
        self.kept, self.young, self.old = kept, {}, {}

    def missing(self, keys: set) -> set:
        """The keys of which nothing is known. What is known of the others is in young until the next call."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        again = new.intersection(self.old) if self.old else ()
        for k in again:
            self.young[k] = self.old[k]
        return new.difference(again)


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    found = public_tokenizers.path(name)
    if not os.path.exists(found):
        raise FileNotFoundError(found)
    return found
