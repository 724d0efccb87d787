"""The export queue as pure functions from queue tables to queue tables.

A row goes pending -> sending -> uploaded, rejected or failed; failed and expired sending rows are claimed again.
Each function takes the table, returns the changed one, and leaves storage to plans.store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.times import backoff_seconds

# Seconds.
LEASE, RETENTION, BATCH = 300, 30 * 86400, 5000


def is_due(now: Column) -> Column:
    return F.col("status").isin("pending", "failed") & (F.col("next_attempt_at") <= now)


def due(queue: DataFrame, now: int, limit: int = 0) -> DataFrame:
    """Due rows, newest first, ids breaking ties; all of them for a limit of 0."""
    rows = queue.where(is_due(F.lit(now))).orderBy(F.desc("ts"), "id")
    return rows.limit(limit) if limit > 0 else rows


def pending_count(queue: DataFrame, now: int) -> DataFrame:
    return queue.where(is_due(F.lit(now))).agg(F.count("*").alias("pending"))


def claimable(queue: DataFrame, now: int, limit: int = 0) -> DataFrame:
    """ids to claim: due rows first, then rows whose lease is over, up to limit in all."""
    fresh = queue.where(is_due(F.lit(now))).select("id", "ts", F.lit(0).alias("turn"))
    stale = queue.where((F.col("status") == "sending") & (F.col("lease_until") <= now)).select("id", "ts", F.lit(1).alias("turn"))
    if limit > 0:
        # Each side needs no more than limit rows, so both are top-k before they meet.
        fresh, stale = (x.orderBy(F.desc("ts"), "id").limit(limit) for x in (fresh, stale))
        return fresh.unionByName(stale).orderBy("turn", F.desc("ts"), "id").limit(limit).select("id")
    return fresh.unionByName(stale).select("id")


def _marked(queue: DataFrame, ids: DataFrame, guard: Column, **values: Column) -> DataFrame:
    said = F.max("reason" if "reason" in ids.columns else F.lit(None).cast("string"))
    named = ids.where(F.coalesce(F.col("id"), F.lit("")) != "").groupBy("id").agg(said.alias("_said")).withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & guard
    return queue.join(named, "id", "left").withColumns({c: F.when(hit, v.cast(queue.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}).select(*queue.columns)


def claim(queue: DataFrame, now: int, limit: int = BATCH, lease: int = LEASE) -> tuple[DataFrame, DataFrame]:
    """The claimed rows, and the queue with them under lease."""
    ids = claimable(queue, now, limit)
    after = _marked(queue, ids, F.lit(True), status=F.lit("sending"), lease_until=F.lit(now + lease))
    return after.join(ids, "id", "left_semi"), after


def release(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims given back: only rows still sending, and no attempt is counted."""
    return _marked(queue, ids, F.col("status") == "sending", status=F.lit("pending"), lease_until=F.lit(0))


def mark_uploaded(queue: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return _marked(queue, ids, F.lit(True), status=F.lit("uploaded"), uploaded_at=F.lit(now), last_error=F.lit(""))


def mark_rejected(queue: DataFrame, ids: DataFrame, reason: str = "") -> DataFrame:
    """Each with its own reason, if ids have any."""
    return _marked(queue, ids, F.lit(True), status=F.lit("rejected"), last_error=F.coalesce(F.nullif("_said", F.lit("")), F.lit(reason)))


def mark_failed(queue: DataFrame, ids: DataFrame, now: int, error: str = "") -> DataFrame:
    """One more attempt counted; the delay goes by the attempts before."""
    return _marked(queue, ids, F.lit(True), status=F.lit("failed"), next_attempt_at=F.lit(now) + backoff_seconds(F.col("attempt_count")), attempt_count=F.col("attempt_count") + 1, last_error=F.lit(error), lease_until=F.lit(0))


def is_over(now: int, retention: int = RETENTION) -> Column:
    return (F.col("status") == "uploaded") & F.coalesce(F.col("uploaded_at") < now - retention, F.lit(False))


def prune(queue: DataFrame, now: int, retention: int = RETENTION) -> DataFrame:
    """Without rows uploaded longer ago than the retention."""
    return queue.where(~is_over(now, retention))


def rejection_reasons(rejects: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("no reason given"))
    return rejects.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def scan_work(files: DataFrame, state: DataFrame, resumable: bool) -> DataFrame:
    """Files to read with the byte to start at: those that changed since the last scan, or weren't read to the end.

    A file that shrank, or that was never read, starts at 0; without resumption each changed file does.
    """
    s = state.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("offset").alias("_offset"))
    both = files.join(s, F.col("path") == F.col("_path"), "left")
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), F.lit(False))
    done = same & (F.coalesce(F.col("_offset"), F.lit(0)) >= F.col("size")) if resumable else same
    start = F.when(F.col("_offset").isNull() | (F.col("size") < F.col("_offset")), 0).otherwise(F.col("_offset")) if resumable else F.lit(0)
    return both.where(~done).select("path", "size", "mtime_ns", start.cast("long").alias("start"))
