"""The wire projection of events, and the loop that drains the queue in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.functions.ids import COUNTERS
from usagelake.functions.paths import relative_entity
from usagelake.functions.text import hash_project_path, normalize_language, normalize_project
from usagelake.functions.times import rfc3339_nano
from usagelake.operators import queue as q
from usagelake.operators.dedupe import insert_ignore
from usagelake.operators.precedence import unacknowledged
from usagelake.plans.log_store import Conflict
from usagelake.schema import USAGE_EVENT
from usagelake.sources.upload import kept_replies, upload


#: Spark's own format of times in JSON ends at milliseconds.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def wire_events(events: DataFrame, zone: str) -> DataFrame:
    """id and event (JSON): no local folders leave the machine, empty fields are left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    files = F.transform("files", lambda f: F.struct(relative_entity(F.col("project_path"), f["path"]).alias("path"), F.nullif(f["lines_added"], F.lit(0)).alias("lines_added"), F.nullif(f["lines_removed"], F.lit(0)).alias("lines_removed")))
    plain = ("source_type", "event_kind", "session_id", "project", "model", "os", "client", "entity_type", "branch", "editor", "category")
    fields = [F.col("id"), F.col("provider"), F.col("provider").alias("source_provider"), rfc3339_nano(F.col("timestamp")).alias("timestamp"), F.lit(zone).alias("timezone"), *[blank(c).alias(c) for c in plain]]
    fields += [F.nullif(hash_project_path(F.col("project_path")), F.lit("")).alias("project_path_hash"), normalize_language(F.col("language")).alias("language"), F.nullif(relative_entity(F.col("project_path"), F.col("entity")), F.lit("")).alias("entity"), F.col("is_write")]
    fields += [F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("lines_added", "lines_removed")] + [F.when(F.size("files") > 0, files).alias("files"), F.col("raw")] + [(F.nullif(F.col(f"usage.{c}"), F.lit(0)) if c != "total_tokens" else F.col("usage.total_tokens")).alias(c) for c in COUNTERS]
    return events.select("id", F.to_json(F.struct(*fields)).alias("event"))


def queue_rows(events: DataFrame) -> DataFrame:
    """Events as fresh rows of the queue."""
    named = events.withColumns({"project": normalize_project(F.col("project")), "language": normalize_language(F.col("language"))})
    zero = F.lit(0).cast("long")
    return named.select("id", F.unix_seconds("timestamp").alias("ts"), F.to_json(F.struct("*"), MICROS).alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), zero.alias("next_attempt_at"), F.lit(None).cast("long").alias("uploaded_at"), F.lit("").alias("last_error"), zero.alias("lease_until"))


def enqueue(queue: DataFrame, events: DataFrame) -> DataFrame:
    return queue.unionByName(insert_ignore(queue, queue_rows(events), "id", ["ts"]))


def add_events(store, events: DataFrame) -> None:
    """Puts events into the queue of a store: what is new is inserted, where the store can, else the whole queue is replaced."""
    if hasattr(store, "insert"):
        store.insert(queue_rows(events))
    else:
        store.replace(enqueue(store.read(), events))


def directory_transport(path: str) -> Callable[[DataFrame], DataFrame]:
    """A sink that writes batches as JSON lines and accepts all: id, verdict."""

    def send(batch: DataFrame) -> DataFrame:
        batch.select("payload").write.mode("append").text(path)
        return batch.select("id", F.lit("accepted").alias("verdict"))

    return send


class PartlySent(Exception):
    """Sending ended early; reply holds the verdicts that came before (id, verdict, reason)."""

    def __init__(self, reply: DataFrame, cause: Exception) -> None:
        super().__init__(str(cause))
        self.reply = reply


def http_transport(url: str, replies: str, zone: str, tasks: int | None = None, **options: str) -> Callable[[DataFrame], DataFrame]:
    """A sink that posts claimed rows of the queue in gzipped batches from the executors. Each call keeps its replies in a
    folder of its own under replies; options as of sources.upload.upload."""

    def send(claimed: DataFrame) -> DataFrame:
        spark = claimed.sparkSession
        folder = f"{replies.rstrip('/')}/{uuid.uuid4().hex}"
        events = claimed.select(F.from_json("payload", USAGE_EVENT).alias("e")).select("e.*")
        try:
            upload(spark, wire_events(events, zone), url, folder, tasks=tasks, **options)
        except Exception as e:
            raise PartlySent(kept_replies(spark, folder), e) from e
        return kept_replies(spark, folder)

    return send


def marked(queue: DataFrame, reply: DataFrame, now: int) -> DataFrame:
    """The queue with a reply's verdicts; a rejected row keeps the reason if one was given."""
    done, refused = reply.where("verdict in ('accepted', 'duplicate')"), reply.where("verdict = 'rejected'")
    return q.mark_rejected(q.mark_uploaded(queue, done, now), refused)


def drain(store, now: Callable[[], int], send: Callable[[DataFrame], DataFrame], batch: int = q.BATCH) -> int:
    """Prunes, then claims, sends and marks batches until none is left; returns the batches sent.

    store keeps the queue (states, with_payload, put); what is written follows the rows that change. If sending fails the batch is marked failed, but
    for rows that got their verdict before, and the loop ends; rows that the reply leaves out are given back and end it, too. Where another drain
    claims at the same time, one of them claims again.
    """
    store.put(store.states().where(q.is_over(now())), gone=True)
    sent = 0
    while True:
        since = store.version()
        claimed = store.keep(q.claim(store.states(), now(), batch)[0])
        if claimed.isEmpty():
            return sent
        try:
            store.put(claimed, since=since)
        except Conflict:
            continue
        mine = lambda: store.states().join(claimed.select("id"), "id", "left_semi")  # noqa: B023, E731
        try:
            reply = store.keep(send(store.with_payload(claimed, narrow=True)))
        except Exception as e:
            rows, failed = mine(), claimed
            if isinstance(e, PartlySent):
                reply = store.keep(e.reply)
                rows, failed = marked(rows, reply, now()), unacknowledged(claimed, reply)
            store.put(q.mark_failed(rows, failed, now(), str(e)[:4096]))
            raise
        left = store.keep(unacknowledged(claimed, reply))
        store.put(q.release(marked(mine(), reply, now()), left))
        sent += 1
        if not left.isEmpty():
            raise RuntimeError("the reply leaves out events of the batch")
