"""Posting events to a server: batches, replies, broken connections, and the queue afterwards."""

import gzip
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from usagelake.api import heartbeats
from usagelake.plans.export import drain, http_transport, queue_rows
from usagelake.plans.store import GenerationStore
from usagelake.sources.upload import UploadWriter, batch_id, kept_replies, upload


class Server:
    """Takes batches and keeps them; fails once at each of the given turns, by status or by hanging up."""

    def __init__(self):
        self.batches, self.heads, self.fail, self.refuse, self.turn, self.lock = [], [], {}, {}, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(gzip.decompress(self.rfile.read(int(self.headers["Content-Length"]))))
                with outer.lock:
                    outer.turn += 1
                    how = outer.fail.pop(outer.turn, None)
                    if how == "hang up":
                        self.close_connection = True
                        return
                    if how is None:
                        known = set(outer.ids())
                        outer.batches.append(body)
                        outer.heads.append(dict(self.headers))
                ids = [e["id"] for e in body["events"]] if how is None else []
                refused = [{"id": i, "reason": outer.refuse[i]} for i in ids if i in outer.refuse]
                taken = [i for i in ids if i not in outer.refuse]
                reply = {"ok": True, "accepted": [i for i in taken if i not in known], "duplicate": [i for i in taken if i in known], "rejected": refused} if how is None else {}
                data = json.dumps(reply).encode() if how is None else b"try later " * 1000
                self.send_response(200 if how is None else how)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}/batch"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def ids(self):
        return [e["id"] for b in self.batches for e in b["events"]]


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


@pytest.mark.parametrize("how", ["hang up", 503])
def test_a_task_that_broke_is_run_again_without_sending_anything_twice(server, tmp_path, how):
    rows = [Row(id=f"{i:03d}", event=json.dumps({"id": f"{i:03d}", "n": i, "text": "é"})) for i in range(25)]
    options = {"url": server.url, "replies": str(tmp_path), "batch": "10", "key": "secret", "name": "box"}
    server.fail[2] = how
    with pytest.raises(OSError) as told:
        UploadWriter(options).write(iter(rows))
    assert len(server.batches) == 1 and (how == "hang up" or "503" in str(told.value) and len(str(told.value)) < 5000)
    sent = UploadWriter(options).write(iter(rows))
    assert (sent.batches, sent.events) == (3, 25)
    assert sorted(server.ids()) == [r.id for r in rows]
    assert [b["batch_id"] for b in server.batches] == [batch_id([r.id for r in rows[n : n + 10]]) for n in (0, 10, 20)]
    assert server.batches[0]["device"] == {"name": "box"} and server.heads[0]["Authorization"] == "Bearer secret"


def test_partitions_are_sent_by_tasks_and_replies_are_a_table(spark, server, tmp_path):
    server.refuse = {"7": "too old", "11": ""}
    events = spark.range(100).select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(F.col("id").cast("string").alias("id"))).alias("event"))
    upload(spark, events, server.url, str(tmp_path / "replies"), batch=9, tasks=3)
    assert Counter(server.ids()) == {str(i): 1 for i in range(100)} and max(len(b["events"]) for b in server.batches) == 9
    replies = kept_replies(spark, str(tmp_path / "replies"))
    assert {(r.verdict, r["count"]) for r in replies.groupBy("verdict").count().collect()} == {("accepted", 98), ("rejected", 2)}
    assert {(r.id, r.reason) for r in replies.where("verdict = 'rejected'").collect()} == {("7", "too old"), ("11", "")}
    upload(spark, events.repartition(7), server.url, str(tmp_path / "replies"), batch=9, tasks=3)
    assert len(server.ids()) == 100
    upload(spark, events.limit(0), server.url, str(tmp_path / "none"))
    assert kept_replies(spark, str(tmp_path / "none")).count() == 0


def test_a_drain_that_breaks_keeps_what_was_said_and_the_next_sends_the_rest(spark, server, tmp_path):
    n = 12
    beats = spark.range(n).select(F.concat(F.lit("/repo/a"), "id", F.lit(".py")).alias("entity"), F.lit("vim").alias("editor"), F.lit("/repo").alias("project_path"), F.lit(True).alias("is_write"), F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("id")).alias("timestamp"))
    store = GenerationStore(spark, str(tmp_path / "queue"))
    store.replace(queue_rows(heartbeats(beats)))
    refused = store.read().orderBy("id").first().id
    server.refuse[refused] = "unknown kind"
    server.fail[3] = 503
    send = http_transport(server.url, str(tmp_path / "replies"), "Europe/Berlin", tasks=1, batch="4")
    with pytest.raises(Exception, match="503"):
        drain(store, lambda: 2_000_000_000, send)
    states = Counter(r.status for r in store.read().collect())
    assert states == {"uploaded": 7, "rejected": 1, "failed": 4}
    assert drain(store, lambda: 2_000_000_000, send) == 0  # not due yet
    assert drain(store, lambda: 2_000_000_031, send) == 1
    rows = {r.id: r for r in store.read().collect()}
    assert Counter(r.status for r in rows.values()) == {"uploaded": 11, "rejected": 1} and rows[refused].last_error == "unknown kind"
    assert Counter(server.ids()) == dict.fromkeys(rows, 1)
    assert {e["timestamp"] for b in server.batches for e in b["events"]} == {"2023-11-14T22:13:20." + str(123456 + i).rstrip("0") + "Z" for i in range(n)}
    assert all(e["timezone"] == "Europe/Berlin" and "/repo" not in json.dumps(e) for b in server.batches for e in b["events"])
