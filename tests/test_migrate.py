"""Queues of before."""

import json
import sqlite3

import pytest

from usagelake.plans.log_store import LogStore
from usagelake.plans.migrate import imported_queue
from usagelake.plans.scan import insert_counted
from usagelake.schema import USAGE_EVENT


def event(name, provider="codex", session="s", at="2026-01-02T03:04:05.5Z", tokens=7):
    return json.dumps({"provider": provider, "id": name, "timestamp": at, "session_id": session, "model": "m", "usage": {"input_tokens": tokens, "total_tokens": tokens}})


def database(path, version, *rows, lease=False):
    con = sqlite3.connect(path)
    con.execute(f"PRAGMA user_version = {version}")
    columns = "id, ts, payload, status, attempt_count, next_attempt_at, uploaded_at, last_error" + (", lease_until" if lease else "")
    con.execute(f"CREATE TABLE usage_events({columns})")
    for name, payload, status in rows:
        con.execute(f"INSERT INTO usage_events VALUES ({','.join('?' * (9 if lease else 8))})", (name, 5, payload, status, 2, 50, 60 if status == "uploaded" else None, "why", *([77] if lease else [])))
    con.commit()
    con.close()
    return str(path)


def test_versions_before_two_are_rekeyed(spark, tmp_path):
    rows = [("a", event("a"), "pending"), ("b", event("b"), "uploaded"), ("c", event("c", session="t"), "failed"), ("d", event("d", "pi"), "rejected"), ("e", "{ not json", "pending"), ("f", event("f", at="never"), "pending"), ("g", event("g"), "sending")]
    for version in (0, 1):
        found = {r.id: r for r in imported_queue(spark, [database(tmp_path / f"v{version}.db", version, *rows)]).collect()}
        plain, moved = {i: r for i, r in found.items() if len(i) == 1}, [r for i, r in found.items() if len(i) == 64]
        assert set(plain) == {"d", "e", "f"} and plain["e"].payload == "{ not json"
        assert sorted((r.status, r.uploaded_at, json.loads(r.payload)["session_id"]) for r in moved) == [("failed", None, "t"), ("uploaded", 60, "s")]
        assert all(json.loads(r.payload)["id"] == r.id and r.lease_until == 0 and (r.attempt_count, r.next_attempt_at, r.last_error) == (2, 50, "why") for r in moved)
    assert {r.id for r in imported_queue(spark, [database(tmp_path / "v2.db", 2, *rows)]).collect()} == set("abcdefg")


def test_several_files_one_queue_and_versions_to_come(spark, tmp_path):
    old = database(tmp_path / "1.db", 1, ("a", event("a"), "pending"), ("x", event("x", "pi"), "pending"))
    new = database(tmp_path / "2.db", 4, ("x", event("x", "pi"), "uploaded"), ("y", event("y", "pi"), "sending"), lease=True)
    queue = imported_queue(spark, [old, new])
    assert {(r.id[:1] if len(r.id) == 1 else "id", r.status, r.lease_until) for r in queue.collect()} == {("id", "pending", 0), ("x", "uploaded", 77), ("y", "sending", 77)}
    store = LogStore(spark, str(tmp_path / "queue"))
    assert store.insert(queue) == 3 and store.insert(queue) == 0
    sqlite3.connect(tmp_path / "3.db").close()
    assert imported_queue(spark, [str(tmp_path / "3.db")]).count() == 0 == imported_queue(spark, []).count()
    with pytest.raises(Exception, match="unknown version"):
        imported_queue(spark, [database(tmp_path / "5.db", 5, ("a", event("a"), "pending"))]).collect()
    seen = spark.createDataFrame([], USAGE_EVENT)
    assert (insert_counted(store, seen).parsed, store.read().count()) == (0, 3)
