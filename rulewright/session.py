"""Sessions: settings for local runs, the package on the executors, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session in this process."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Put the package's modules on the Python path of the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="rulewright-")
    path = os.path.join(folder, "rulewright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("rulewright", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        named = "file://" + tempfile.mkdtemp(prefix="rulewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of a table that is broadcast by hint; of a larger one Spark finds the size and picks the join.
SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has no more than so many rows, which one short job finds out; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_sort(df: DataFrame) -> DataFrame:
    """The frame for a join by a sort. Spark takes rows that are made in a plan for as small as the part of a file that they are made from, and would broadcast any number of them through the driver."""
    return df.hint("merge")


def deal(df: DataFrame, *by: str) -> DataFrame:
    """The frame's rows (of one key together) over as many tasks as the session has shuffle partitions: for small rows of much work, which a file of one piece or Spark's merging of small partitions would leave to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of one task where a task's memory would else grow with what Spark's merging of small partitions leaves to it: rows that compress well look small to it.
TASK_ROWS = 50_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """In how many partitions a key's rows are to be dealt so that one has about so many of the frame's at most; no fewer than the session's, as Spark would deal them anew. None if all are no more than that. Counts the frame."""
    n = df.count()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)) if n > rows else None


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to a new table in the shared folder and read it back: its lineage ends there and lost executors lose nothing.

    The table goes when the driver's process ends; the shuffle files of the write go when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended before; then the folder's owner cleans up
        return
