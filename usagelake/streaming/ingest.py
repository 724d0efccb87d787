"""Incremental ingest of append-only logs: tail, parse, and insert what isn't stored yet."""

from __future__ import annotations

import json
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelake.operators.identity import IDENTITY_FILE, with_identity
from usagelake.plans.export import add_events
from usagelake.providers.base import REGISTRY
from usagelake.sources.tail import TailSource
from usagelake.streaming.segments import held_lines, state_in_rocksdb, whole_segments


#: What a micro-batch of a query that keeps running takes at most.
BATCH_BYTES = 256 << 20


def tailed_lines(spark: SparkSession, paths: list[str], *needed: str, batch_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("jsonl_tail").options(path=",".join(paths), needed=json.dumps(list(needed)), max_bytes=str(batch_bytes)).load()
    return rows.select("path", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)).alias("mtime"), "line", "start", "stop", "value")


def provider_lines(spark: SparkSession, provider: str, paths: list[str], batch_bytes: int = 0, hold: str | None = None) -> DataFrame:
    """A provider's new lines; with hold those that belong to one row come in one batch."""
    p = REGISTRY[provider]
    if p.from_lines is None:
        raise ValueError(f"{provider} can't be resumed")
    lines = tailed_lines(spark, paths, *p.needed, batch_bytes=batch_bytes)
    if hold is None:
        return lines
    if p.marked is None:
        raise ValueError(f"{provider} has no lines that belong to others")
    return whole_segments(p.marked(lines), hold)


def held_events(spark: SparkSession, provider: str, checkpoint: str) -> DataFrame:
    """Events that a query with hold has read and not let go yet, with what belongs to them so far."""
    return REGISTRY[provider].from_lines(held_lines(spark, checkpoint))


def ingest(spark: SparkSession, provider: str, paths: list[str], store, checkpoint: str, once: bool = True, every: str = "5 minutes", identity: str | DataFrame | None = IDENTITY_FILE, batch_bytes: int | None = None, hold: str | None = None) -> StreamingQuery:
    """A query that puts a provider's new events into the queue of a store.

    Each batch is inserted before its offsets are committed, and ids make a repeated batch harmless. A batch is
    parsed by itself: a patch at its start belongs to the first usage row of the batch, unless hold (as "10 minutes") says how long a row
    waits for its patches, when batches may end anywhere. Such a checkpoint is continued with hold only. Identity files name projects.
    A query that runs once takes all there is in one batch, unless batch_bytes bounds it, when the rest is left to the next run; one that
    keeps running takes batch_bytes at a time, BATCH_BYTES if not given, and all at once for 0.
    """
    p = REGISTRY[provider]

    def insert(batch: DataFrame, _: int) -> None:
        events = p.from_lines(batch)
        events = events if identity is None else with_identity(events, identity)
        if not events.isEmpty():
            add_events(store, events)

    lines = provider_lines(spark, provider, paths, (0 if once else BATCH_BYTES) if batch_bytes is None else batch_bytes, hold)
    writer = lines.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    with state_in_rocksdb(spark) if hold else nullcontext():
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def caught_up(query: StreamingQuery) -> list[dict]:
    """Waits until a query has taken all there is, and ends it; the progress of its latest batches."""
    try:
        query.processAllAvailable()
        return [json.loads(p.json) for p in query.recentProgress]
    finally:
        query.stop()


def catch_up(spark: SparkSession, provider: str, paths: list[str], store, checkpoint: str, batch_bytes: int = BATCH_BYTES, identity: str | DataFrame | None = IDENTITY_FILE, hold: str | None = None) -> list[dict]:
    """Takes all that is there in batches of at most batch_bytes; the progress of each. A run that ends early is continued by the next."""
    return caught_up(ingest(spark, provider, paths, store, checkpoint, False, "0 seconds", identity, batch_bytes, hold))


def tail_to_table(spark: SparkSession, provider: str, paths: list[str], out: str, checkpoint: str, batch_bytes: int = BATCH_BYTES, hold: str | None = None) -> list[dict]:
    """Appends a provider's new events to Parquet at out, in batches of at most batch_bytes, till all is taken; the progress of each.

    Each batch has a folder of its own (column batch), which a batch that is run again writes anew. A last line that still grows may come
    once more with a later batch, under another id if its text changed. With hold, what is still held is in held_events.
    """
    p = REGISTRY[provider]

    def put(lines: DataFrame, number: int) -> None:
        p.from_lines(lines).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = provider_lines(spark, provider, paths, batch_bytes, hold).writeStream.foreachBatch(put)
    with state_in_rocksdb(spark) if hold else nullcontext():
        query = writer.option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    return caught_up(query)
