"""Queues of before: SQLite files of any version as rows of the queue.

A file's version is its user_version. Before version 2 ids of one provider's events held where they came from, so one event read from two places was there twice;
its rows get ids by content, and of those that fall together the one that got furthest stays. Version 3 changed nothing here and version 4
added the lease, which is 0 in files without it. Each file is read by a task of its own. How far files were scanned isn't taken over: the next scan reads them
from the start, and ids keep it from adding anything twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.functions.ids import stable_id
from usagelake.functions.times import rfc3339_nano
from usagelake.operators.dedupe import rekey
from usagelake.plans.export import MICROS
from usagelake.schema import QUEUE, USAGE_EVENT
from usagelake.sources.sqlite import read_table

#: Of the queue's SQLite files; later ones aren't known here.
VERSION = 4
REKEYED_FROM = 2
COUNTED = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def typed(schema: str) -> list[Column]:
    """Cells of text as columns of schema: numbers that are missing are 0, texts empty; null where no upload was."""
    fields = [c.split(" ") for c in schema.split(", ")]
    number = lambda c, kind: F.col(c).try_cast(kind) if c == "uploaded_at" else F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind))
    return [F.coalesce(F.col(c), F.lit("")).alias(c) if kind == "string" else number(c, kind).alias(c) for c, kind in fields]


def names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def versions(spark: SparkSession, dbs: list[str]) -> DataFrame:
    """path and version of each file; one of a later version than known ends the job that reads it."""
    found = read_table(spark, dbs, "pragma_user_version", ["user_version"]).select("path", F.col("user_version").cast("int").alias("version"))
    late = F.concat(F.lit("unknown version of "), "path", F.lit(": "), F.col("version").cast("string"))
    return found.withColumn("version", F.when(F.col("version") > VERSION, F.raise_error(late).cast("int")).otherwise(F.col("version")))


def content_id(j: Column) -> Column:
    """The id by content of a stored event: session, time, model and tokens."""
    return stable_id(v.text(j, "$.provider"), v.text(j, "$.session_id"), rfc3339_nano(v.time(j, "$.timestamp")), v.text(j, "$.model"), *[v.count(j, f"$.usage.{c}") for c in COUNTED])


def rekeyed(rows: DataFrame) -> DataFrame:
    """Rows (path, row, those of the queue) of the old kind with ids by content; other providers' rows, those without a time and those that
    can't be read keep theirs."""
    rows = rows.withColumn("j", v.parsed(F.col("payload")))
    old = (v.text(F.col("j"), "$.provider") == "codex") & v.time(F.col("j"), "$.timestamp").isNotNull()
    moved = rows.withColumn("new_id", F.when(F.coalesce(old, F.lit(False)), content_id(F.col("j"))).otherwise(F.col("id"))).drop("j")
    kept = rekey(moved, ["path", "new_id"], "status", ["row"])
    event = F.from_json("payload", USAGE_EVENT)
    payload = F.when(F.col("new_id") == F.col("id"), F.col("payload")).otherwise(F.to_json(event.withField("id", F.col("new_id")), MICROS))
    return kept.withColumn("payload", payload).withColumn("id", F.col("new_id")).drop("new_id")


def imported_queue(spark: SparkSession, dbs: list[str]) -> DataFrame:
    """The rows of old queues in today's shape; of an id in several files the row that got furthest, then that of the first file."""
    rows = read_table(spark, dbs, "usage_events", names(QUEUE)).select("path", "row", *typed(QUEUE))
    rows = rows.withColumn("status", F.when(F.col("status") == "", "pending").otherwise(F.col("status"))).join(versions(spark, dbs), "path")
    columns = ["path", "row", *names(QUEUE)]
    old, new = rekeyed(rows.where(F.col("version") < REKEYED_FROM)), rows.where(F.col("version") >= REKEYED_FROM)
    both = old.select(*columns).unionByName(new.select(*columns)).withColumn("key", F.col("id"))
    return rekey(both, ["key"], "status", ["path", "row"]).select(*names(QUEUE))
