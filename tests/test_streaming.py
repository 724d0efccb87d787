"""Byte-offset tailing, and the queue from ingest to export."""

import json

import pytest
from pyspark.sql import functions as F

from usagelake.api import heartbeats, load_usage
from usagelake.operators import queue as q
from usagelake.plans.export import directory_transport, drain, enqueue, queue_rows, wire_events
from usagelake.plans.store import GenerationStore
from usagelake.sources.lines import split_lines
from usagelake.sources.tail import TailReader, last_line_end
from usagelake.streaming.ingest import catch_up, ingest


def line(n):
    return json.dumps({"type": "message", "timestamp": f"2026-01-02T03:04:{n:02d}Z", "message": {"role": "assistant", "model": "gpt-5", "usage": {"input": n, "output": 1}}})


@pytest.mark.parametrize("cut", [0, 1, 7, 8, 12])
def test_lines_cut_anywhere_keep_their_places(cut):
    body = "é1\r\n{}\nbad\nlast".encode()
    whole = list(split_lines(body))
    assert [(b, e) for _, b, e, _, _ in whole] == [(0, 5), (5, 8), (8, 12), (12, 16)]
    assert [x[3] for x in whole] == ["é1".encode(), b"{}", b"bad", b"last"] and [x[4] for x in whole] == [True, True, True, False]
    starts = [b for _, b, *_ in whole] + [len(body)]
    at = max(s for s in starts if s <= cut)
    assert [x[1:] for x in split_lines(body[at:], at)] == [x[1:] for x in whole if x[1] >= at]


def test_offsets_stop_before_a_partial_line_and_restart_on_truncation(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\nthr")
    assert last_line_end(str(f), 0, 11) == 8
    reader = TailReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    assert first[str(f)][0] == 8
    assert [x[6] for p in reader.partitions({}, first) for x in reader.read(p)] == ["one", "two", "thr"]
    f.write_bytes(b"one\ntwo\nthree\nfour\n")
    second = reader.latestOffset()
    assert [x[6] for p in reader.partitions(first, second) for x in reader.read(p)] == ["three", "four"]
    f.write_bytes(b"new\n")
    third = reader.latestOffset()
    assert [x[6] for p in reader.partitions(second, third) for x in reader.read(p)] == ["new"]
    assert [x for p in reader.partitions(third, third) for x in reader.read(p)] == []


def batches_of(reader, start=None):
    """The spans of each batch until nothing is new, with the lines read."""
    start = {} if start is None else start
    while True:
        end = reader.latestOffset()
        spans = [p for p in reader.partitions(start, end) if p.path]
        if not spans:
            return
        yield end, spans, [(x[0], x[4], x[6], x[7]) for p in spans for x in reader.read(p)]
        start = end


@pytest.mark.parametrize("budget", [1, 7, 30, 64, 1000])
def test_bounded_batches_read_what_one_batch_reads(tmp_path, budget):
    long = b"y" * 90
    bodies = {"a.jsonl": b"one\n\ntwo\r\n" + long + b"\nend\npart", "b.jsonl": b"\n".join(b"%d" % (7**i) for i in range(20)) + b"\n", "c.jsonl": b"", "d.jsonl": b"only part"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    [(_, _, whole)] = batches_of(TailReader({"path": str(tmp_path)}))
    found = []
    for _, spans, rows in batches_of(TailReader({"path": str(tmp_path), "max_bytes": str(budget)})):
        size = sum(p.stop - p.start for p in spans)
        assert size <= budget or len(rows) == 1
        found += rows
    assert sorted(found) == sorted(whole) and len(set(found)) == len(found)


def test_a_busy_file_keeps_no_other_waiting_and_a_restart_goes_on(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"xxx\n" * 100)
    (tmp_path / "b.jsonl").write_bytes(b"yyy\n" * 3)
    options = {"path": str(tmp_path), "max_bytes": "8"}
    turns = [{r[2] for r in rows} for _, _, rows in batches_of(TailReader(options))]
    assert turns[:4] == [{"xxx"}, {"yyy"}, {"xxx"}, {"yyy", "xxx"}]
    first = TailReader(options)
    done, seen = {}, []
    for end, _, rows in batches_of(first):
        done, seen = end, seen + rows
        if len(seen) > 20:
            break
    again = TailReader(options)
    again.partitions(done, done)  # how Spark tells a new reader where the last one was
    for _, _, rows in batches_of(again, done):
        seen += rows
    assert len(seen) == len(set(seen)) == 103


class Breaking:
    """A store that fails at one of its changes."""

    def __init__(self, store, at):
        self.store, self.at, self.n, self.read = store, at, 0, store.read

    def replace(self, queue):
        self.n += 1
        if self.n == self.at:
            raise OSError("the store is away")
        self.store.replace(queue)


def test_bounded_ingest_stopped_in_the_middle_equals_batch(spark, tmp_path):
    logs = tmp_path / "sessions" / "demo"
    logs.mkdir(parents=True)
    for name in "ab":
        (logs / f"agent_{name}.jsonl").write_text("".join(line(n + 10 * (name == "b")) + "\n" for n in range(1, 7)))
    store, size = GenerationStore(spark, str(tmp_path / "queue")), len(line(1)) + 1
    paths, checkpoint = [str(tmp_path / "sessions")], str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="the store is away"):
        catch_up(spark, "pi", paths, Breaking(store, 3), checkpoint, 2 * size + 5, None)
    assert store.read().count() == 4
    told = catch_up(spark, "pi", paths, store, checkpoint, 2 * size + 5, None)
    taken = [sum(e[1] for e in p["sources"][0]["endOffset"].values()) - sum(e[1] for e in (p["sources"][0]["startOffset"] or {}).values()) for p in told]
    assert max(taken) <= 2 * size + 5 and sum(taken) >= 8 * size and len([n for n in taken if n]) >= 4
    assert {r.id for r in store.read().collect()} == {r.id for r in load_usage(spark, "pi", paths).collect()}
    with open(logs / "agent_a.jsonl", "a") as f:
        f.write(line(30) + "\n")
    ingest(spark, "pi", paths, store, checkpoint, identity=None).awaitTermination()
    assert store.read().count() == 13


def test_stream_ingest_equals_batch_and_drains_once(spark, tmp_path):
    logs = tmp_path / "sessions" / "demo"
    logs.mkdir(parents=True)
    f = logs / "agent_a.jsonl"
    store = GenerationStore(spark, str(tmp_path / "queue"))
    run = lambda: ingest(spark, "pi", [str(tmp_path / "sessions")], store, str(tmp_path / "checkpoint")).awaitTermination()
    f.write_text(line(1) + "\n" + line(2))
    run()
    assert store.read().count() == 2  # the last line counts though its line feed is still missing
    run()
    assert store.read().count() == 2
    f.write_text(line(1) + "\n" + line(2) + "\n" + line(3) + "\n")
    run()
    batch = load_usage(spark, "pi", [str(tmp_path / "sessions")])
    assert {r.id for r in store.read().collect()} == {r.id for r in batch.collect()}
    clock = lambda: 2_000_000_000
    assert drain(store, clock, directory_transport(str(tmp_path / "out")), batch=2) == 2
    assert {r.status for r in store.read().collect()} == {"uploaded"}
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    assert drain(store, clock, directory_transport(str(tmp_path / "out"))) == 0


def queue(spark, *rows):
    return spark.createDataFrame([(i, ts, "{}", s, n, due, None, "", lease) for i, ts, s, n, due, lease in rows], "id string, ts bigint, payload string, status string, attempt_count int, next_attempt_at bigint, uploaded_at bigint, last_error string, lease_until bigint")


def test_claims_take_due_rows_first_then_expired_leases(spark):
    t = queue(spark, ("a", 1, "pending", 0, 0, 0), ("b", 2, "failed", 1, 50, 0), ("c", 3, "failed", 1, 500, 0), ("d", 9, "sending", 0, 0, 90), ("e", 8, "sending", 0, 0, 900), ("f", 7, "uploaded", 0, 0, 0))
    claimed, after = q.claim(t, 100, 3)
    assert {r.id for r in claimed.collect()} == {"a", "b", "d"}
    assert {r.id: r.lease_until for r in after.collect() if r.status == "sending"} == {"a": 400, "b": 400, "d": 400, "e": 900}
    assert {r.id for r in q.claim(after, 100, 3)[0].collect()} == set()
    assert [r.id for r in q.due(t, 100, 1).collect()] == ["b"]


def test_backoff_doubles_to_an_hour(spark):
    t = queue(spark, ("a", 1, "pending", 0, 0, 0))
    delays = []
    for _ in range(9):
        t = q.mark_failed(t, t, 1000)
        t = spark.createDataFrame(t.collect(), t.schema)
        delays.append(t.first().next_attempt_at - 1000)
    assert delays == [30, 60, 120, 240, 480, 960, 1920, 3600, 3600]


def test_failed_transport_marks_the_batch(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "q"))
    store.replace(queue(spark, ("a", 1, "pending", 0, 0, 0)))

    def broken(_):
        raise OSError("no route")

    with pytest.raises(OSError):
        drain(store, lambda: 100, broken)
    row = store.read().first()
    assert (row.status, row.attempt_count, row.next_attempt_at, row.last_error) == ("failed", 1, 130, "no route")


def test_heartbeat_to_wire(spark):
    beat = spark.createDataFrame([("/repo/src/App.java", "VSCode", "/repo", True)], "entity string, editor string, project_path string, is_write boolean").withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))
    events = heartbeats(beat)
    wire = json.loads(wire_events(events, "Europe/Berlin").first().event)
    assert (wire["entity"], wire["language"], wire["project"], wire["is_write"], wire["provider"], wire["category"]) == ("src/App.java", "Java", "repo", True, "vscode", "coding")
    assert "/repo" not in json.dumps(wire) and len(wire["project_path_hash"]) == 64 and wire["timestamp"] == "2023-11-14T22:13:20Z"
    assert enqueue(queue_rows(events), events).count() == 1
    with pytest.raises(Exception, match="without id"):
        enqueue(queue_rows(events), events.withColumn("id", F.lit(""))).collect()
