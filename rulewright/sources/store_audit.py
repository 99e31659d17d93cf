"""All contracts of a store at once: every file read and hashed by Spark, each folder held against the list of hashes that was written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the files of a contract's folder, and the list of their hashes.
FILES, READY = ("body.json", "manifest.json", "review.json"), "ready.json"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Columns key, name, content: the files of every contract under a folder, local or remote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("key"), F.element_at(parts, -1).alias("name"), F.decode("content", "UTF-8").alias("content")).filter(F.col("name").isin(*FILES, READY))


def audit(files: DataFrame) -> DataFrame:
    """Columns key, state, fault, status, model, effort, generated_at, body: a row for each folder (files: key, name, content).

    unfinished: there is no list of hashes; damaged: a file is missing or has another hash, is no JSON object, or belongs to another key (fault names the first
    such file); blocked: its review has blocked it; usable: all others. Only these two have a status, and only a usable one a body. A folder's files meet as
    one row by an aggregate, so folders are dealt over all tasks.
    """
    content = lambda name: F.max(F.when(F.col("name") == name, F.col("content"))).alias(name)
    whole = files.groupBy("key").agg(*[content(n) for n in (*FILES, READY)])
    hashes = F.from_json(F.col(f"`{READY}`"), "map<string,string>")

    def broken(name: str) -> F.Column:
        text = F.col(f"`{name}`")
        good = (F.sha2(text, 256) == F.try_element_at(hashes, F.lit(name))) & F.json_object_keys(text).isNotNull()
        if name == "manifest.json":
            good &= F.get_json_object(text, "$.cache_key") == F.col("key")
        return F.when(~F.coalesce(good, F.lit(False)), name)

    status = F.get_json_object(F.col("`review.json`"), "$.status")
    told = whole.withColumn("fault", F.when(F.col(f"`{READY}`").isNull(), READY).otherwise(F.coalesce(*map(broken, FILES))))
    state = F.when(F.col("fault") == READY, "unfinished").when(F.col("fault").isNotNull(), "damaged").when(status == "blocked", "blocked").otherwise("usable")
    of = lambda name: F.when(F.col("fault").isNull(), F.get_json_object(F.col("`manifest.json`"), f"$.{name}")).alias(name)
    return told.select("key", state.alias("state"), "fault", F.when(F.col("fault").isNull(), status).alias("status"), *map(of, ("model", "effort", "generated_at")), F.when(state == "usable", F.col("`body.json`")).alias("body"))


def best(audited: DataFrame, model: str, effort: str) -> DataFrame:
    """Column key, one row: the usable contract of this model and effort that was made last, or of others if there is none; NULL if none is usable."""
    own = F.coalesce((F.col("model") == model) & (F.col("effort") == effort), F.lit(False))
    return audited.filter("state = 'usable'").agg(F.max_by("key", F.struct(own, F.coalesce("generated_at", F.lit("")), "key")).alias("key"))
