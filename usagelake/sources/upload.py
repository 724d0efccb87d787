"""A sink that posts events in gzipped batches, each once even if its task is run again.

Rows are id and event (JSON). A batch's id is a hash of its events' ids, and a task's rows come in the order of their ids, so a task that is
run again makes the same batches. The reply to a batch is kept in a folder, named by the batch, before the next one is sent; a batch with a kept
reply isn't sent again. What is sent twice is at most the batch whose reply was lost on its way; the server knows it by its id.
The folder may be on any file system pyarrow knows and must be reached by all executors.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

REPLY = "batch_id string, id string, verdict string, reason string"
#: Events of a batch, seconds to wait, bytes of an error that are kept.
BATCH, WAIT, DETAIL = 5000, 120, 4096


@dataclass
class Sent(WriterCommitMessage):
    batches: int
    events: int


def batch_id(ids: list[str]) -> str:
    return "usage-" + hashlib.sha256("\n".join(ids).encode()).hexdigest()


def verdicts(batch: str, reply: dict) -> str:
    """A line of JSON for each event that the reply names."""
    rows = [(i, v, "") for v, key in (("accepted", "accepted"), ("duplicate", "duplicate")) for i in reply.get(key) or []]
    rows += [(r["id"], "rejected", r.get("reason") or "") for r in reply.get("rejected") or [] if r.get("id")]
    return "".join(json.dumps({"batch_id": batch, "id": i, "verdict": v, "reason": r}) + "\n" for i, v, r in rows)


class UploadWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.url, self.replies = options["url"], options["replies"]
        self.size, self.wait = int(options.get("batch", BATCH)), float(options.get("wait", WAIT))
        self.key, self.agent = options.get("key", ""), options.get("agent", "usagelake")
        self.device = {k: v for k in ("name", "platform", "app_version") if (v := options.get(k))}

    def write(self, iterator: Iterator[Row]) -> Sent:
        store, folder = fs.FileSystem.from_uri(self.replies)
        batches = events = 0
        rows: list[Row] = []
        for row in iterator:
            rows.append(row)
            if len(rows) == self.size:
                batches, events, rows = batches + 1, events + self.put(store, folder, rows), []
        if rows:
            batches, events = batches + 1, events + self.put(store, folder, rows)
        return Sent(batches, events)

    def put(self, store: fs.FileSystem, folder: str, rows: list[Row]) -> int:
        name = batch_id([r.id for r in rows])
        path = f"{folder}/{name}.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            body = f'{{"batch_id": {json.dumps(name)}, "device": {json.dumps(self.device)}, "events": [{",".join(r.event for r in rows)}]}}'
            kept = verdicts(name, self.post(body.encode())).encode()
            # Under a name that no reader takes until all of it is there.
            with store.open_output_stream(f"{folder}/_{name}") as out:
                out.write(kept)
            store.move(f"{folder}/_{name}", path)
        return len(rows)

    def post(self, body: bytes) -> dict:
        headers = {"Content-Type": "application/json", "Content-Encoding": "gzip", "User-Agent": self.agent}
        if self.key:
            headers["Authorization"] = f"Bearer {self.key}"
        # A fixed time in the header, so that equal batches are equal bytes.
        request = urllib.request.Request(self.url, gzip.compress(body, mtime=0), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.wait) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            raise OSError(f"the server returned {e.code}: {e.read(DETAIL).decode('utf-8', 'replace').strip()}") from None

    def commit(self, messages: list[Sent | None]) -> None:
        pass  # replies are the result; the batches are no transaction together

    def abort(self, messages: list[Sent | None]) -> None:
        pass  # what got a reply stays sent, and its reply stays kept


class UploadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usage_upload"

    def schema(self) -> str:
        return "id string, event string"

    def writer(self, schema, overwrite: bool) -> UploadWriter:
        return UploadWriter(dict(self.options))


def upload(spark: SparkSession, events: DataFrame, url: str, replies: str, batch: int = BATCH, tasks: int | None = None, **options: str) -> None:
    """Posts id and event. Options: key, agent, wait, and the device's name, platform and app_version."""
    store, folder = fs.FileSystem.from_uri(replies)
    store.create_dir(folder, recursive=True)
    spark.dataSource.register(UploadSource)
    rows = events.select("id", "event")
    # An event stays with its partition and its place, whatever the partitions of the input are.
    rows = (rows.repartition(tasks, "id") if tasks else rows.repartition("id")).sortWithinPartitions("id")
    rows.write.format("usage_upload").mode("append").options(url=url, replies=replies, batch=str(batch), **options).save()


def kept_replies(spark: SparkSession, replies: str) -> DataFrame:
    """What the server said of each event so far: batch_id, id, verdict, reason."""
    return spark.read.schema(REPLY).json(replies).where(F.coalesce("id", F.lit("")) != "")
