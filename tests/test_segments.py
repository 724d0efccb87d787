"""State across micro-batches: what a stream finds equals what is found in whole files, wherever batches end."""

import json

import pytest
from pyspark.sql import Row

from usagelake.api import load_usage
from usagelake.plans.store import GenerationStore
from usagelake.schema import USAGE_EVENT
from usagelake.streaming.ingest import catch_up, held_events, ingest, tail_to_table
from usagelake.streaming.segments import NAMES, Segments, in_order


def used(n):
    return json.dumps({"sessionId": "s", "requestId": f"r{n}", "timestamp": f"2026-01-02T03:04:{n:02d}Z", "cwd": "/work/p", "message": {"id": f"m{n}", "model": "x", "usage": {"input_tokens": n + 1, "output_tokens": 2}}}, separators=(",", ":"))


def changed(name, added):
    return json.dumps({"toolUseResult": {"filePath": f"/work/p/{name}", "structuredPatch": [{"lines": ["+x"] * added + ["-y"]}]}}, separators=(",", ":"))


FILES = {
    "one": [changed("early.py", 1), used(1), changed("a.py", 2), changed("b.go", 3), '{"type":"user"}', used(2), used(3), changed("c.rs", 4), "{ no", changed("a.py", 5), used(4), changed("end.c", 6)],
    "two": [used(11), changed("z.py", 7), changed("z.py", 8)],
    "three": [changed("lost.py", 9)],
}


def written(root, files=FILES):
    for name, lines in files.items():
        (root / "projects" / "p").mkdir(parents=True, exist_ok=True)
        (root / "projects" / "p" / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines))
    return [str(root / "projects")]


def facts(rows):
    return sorted((r.id, r.lines_added, r.lines_removed, r.entity or "", [tuple(f) for f in r.files or []]) for r in rows.collect())


@pytest.mark.parametrize("budget", [500])
def test_a_stream_cut_anywhere_equals_batch(spark, tmp_path, budget):
    paths = written(tmp_path)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    told = tail_to_table(spark, "claude", paths, out, checkpoint, budget, "1 hour")
    assert len(told) > 2200 // budget
    found, held = spark.read.schema(USAGE_EVENT).parquet(out).drop("batch"), held_events(spark, "claude", checkpoint)
    assert (found.count(), held.count()) == (3, 2)  # the last row of each file may still get changes
    assert facts(found.unionByName(held)) == facts(load_usage(spark, "claude", paths))


def test_runs_that_go_on_and_a_hold_that_ends(spark, tmp_path):
    store, checkpoint = GenerationStore(spark, str(tmp_path / "queue")), str(tmp_path / "checkpoint")
    half = {name: lines[: len(lines) // 2] for name, lines in FILES.items()}
    paths = written(tmp_path, half)
    ingest(spark, "claude", paths, store, checkpoint, identity=None, hold="1 hour").awaitTermination()
    assert store.read().count() == 1  # r1; the rows that are open wait
    written(tmp_path)
    catch_up(spark, "claude", paths, store, checkpoint, 300, None, "1 hour")
    whole = {r.id: r.lines_added for r in load_usage(spark, "claude", paths).collect()}
    payloads = {r.id: json.loads(r.payload) for r in store.read().collect()}
    assert len(payloads) == 3 and {i: p.get("lines_added") or 0 for i, p in payloads.items()} == {i: whole[i] or 0 for i in payloads}


def test_a_hold_that_is_over_lets_rows_go(spark, tmp_path):
    store, checkpoint = GenerationStore(spark, str(tmp_path / "queue")), str(tmp_path / "checkpoint")
    paths = written(tmp_path)
    for n in (20, 21):
        ingest(spark, "claude", paths, store, checkpoint, identity=None, hold="1 second").awaitTermination()
        written(tmp_path, {f"more{n}": [used(n)]})
    ingest(spark, "claude", paths, store, checkpoint, identity=None, hold="1 second").awaitTermination()
    whole = {r.id: r.lines_added or 0 for r in load_usage(spark, "claude", [p for p in paths]).collect()}
    payloads = {r.id: json.loads(r.payload).get("lines_added") or 0 for r in store.read().collect()}
    assert len(payloads) >= 5 and all(whole[i] == n for i, n in payloads.items())


def test_providers_without_such_lines_and_without_resumption_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no lines that belong"):
        tail_to_table(spark, "pi", [str(tmp_path)], "", "", hold="1 hour")
    with pytest.raises(ValueError, match="can't be resumed"):
        tail_to_table(spark, "codex", [str(tmp_path)], "", "")


class State:
    """A list or value state in memory."""

    def __init__(self):
        self.kept = []

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept) if isinstance(self.kept, list) else self.kept

    def clear(self):
        self.kept = []

    def appendList(self, rows):
        self.kept = [*self.kept, *rows]

    def update(self, value):
        self.kept = value


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return State()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def row(at, value, arrived=1):
    return Row(**dict(zip(NAMES, ("f", None, 1, at, at + 1, value))), opens=value.startswith("u"), arrived_ms=arrived)


def test_lines_read_twice_files_that_begin_anew_and_timers():
    p, handle = Segments(), Handle()
    p.init(handle)
    step = lambda *rows: [r.value for r in p.handleInputRows(("f",), iter(rows), None)]
    expire = lambda: [r.value for r in p.handleExpiredTimer(("f",), None, None)]
    assert step(row(0, "p0")) == [] and handle.timers == set()  # nothing to go to yet
    assert step(row(5, "p5", 2), row(1, "u1", 2)) == [] and handle.timers == {2}
    assert step(row(5, "p5 once more", 3)) == [] and handle.timers == {3}
    assert step(row(9, "u9", 4)) == ["p0", "u1", "p5 once more"]
    assert step(row(9, "u9", 5), row(10, "p10", 5)) == [] and handle.timers == {5}
    assert step(row(2, "p2 of a new file", 6)) == ["u9", "p10"] and handle.timers == set()
    assert step(row(3, "u3", 7), row(4, "u4", 7), row(6, "u6", 7)) == ["p2 of a new file", "u3", "u4"]
    handle.timers.clear()
    assert expire() == ["u6"] and step(row(7, "p7", 8)) == [] and step(row(8, "u8", 9)) == []
    assert step(row(11, "u11", 10)) == ["p7", "u8"]
    assert [r.start for r in in_order([("f", None, 1, 3, 4, "a"), ("f", None, 1, 1, 2, "b")])] == [1, 3]
