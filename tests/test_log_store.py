"""The queue as a log of changed rows."""

import glob

import pytest
from pyspark.sql import functions as F

from usagelake.operators import queue as q
from usagelake.plans.export import directory_transport, drain
from usagelake.plans.log_store import Conflict, LogStore
from usagelake.schema import QUEUE


def rows(spark, *ids, status="pending", uploaded=None):
    return spark.createDataFrame([(i, int(i), f"payload {i}", status, 0, 0, uploaded, "", 0) for i in ids], QUEUE)


def states(store):
    return {r.id: (r.status, r.payload) for r in store.read().collect()}


def test_a_drain_writes_what_it_changes(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "q"))
    assert store.read().count() == 0 and store.states().count() == 0
    assert store.insert(rows(spark, *map(str, range(12)))) == 12
    assert store.insert(rows(spark, "3", "3", "12", "12")) == 1 and store.insert(rows(spark, "3")) == 0
    assert drain(store, lambda: 100, directory_transport(str(tmp_path / "out")), batch=4) == 4
    assert states(store) == {str(i): ("uploaded", f"payload {i}") for i in range(13)}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"payload {i}" for i in range(13))
    m = store.manifest()
    # Each row was inserted, claimed and marked once, whatever the number of batches.
    assert (m["rows"], m["changes"], len(m["inserts"])) == (13, 26, 2)
    assert sum(spark.read.parquet(f).count() for f in m["log"]) == 39 and set(m["log"]) == {f"{tmp_path}/q/log/{x.split('/')[-1]}" for x in glob.glob(str(tmp_path / "q/log/*"))}
    assert spark.read.parquet(*m["log"]).where("payload is not null").count() == 13
    assert drain(store, lambda: 100 + q.RETENTION + 1, directory_transport(str(tmp_path / "out"))) == 0
    assert store.read().count() == 0


def test_claims_read_no_payload_and_payloads_are_pruned_by_time(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "q"))
    store.insert(rows(spark, "1", "2", "3"))
    text = lambda df: df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "payload:string" not in text(q.claim(store.states(), 100, 2)[0])
    assert "GreaterThanOrEqual(ts,2)" in text(store.with_payload(store.states().where("id > '1'"), narrow=True))


def test_a_second_writer_changes_nothing(spark, tmp_path):
    a, b = LogStore(spark, str(tmp_path / "q")), LogStore(spark, str(tmp_path / "q"))
    a.insert(rows(spark, "1", "2"))
    since = b.version()
    claimed, _ = q.claim(a.states(), 100)
    assert a.put(claimed, since=since) == 2
    with pytest.raises(Conflict):
        b.put(claimed.withColumn("lease_until", F.lit(9).cast("long")), since=since)
    with pytest.raises(Conflict):
        b._commit({**b.manifest(), "version": since})
    assert {r.lease_until for r in a.read().collect()} == {400}
    assert len(glob.glob(str(tmp_path / "q/log/*"))) == 2 and not glob.glob(str(tmp_path / "q/manifest/*.draft"))
    # A change that doesn't depend on a version goes on from the other's.
    commit, turns = b._commit, []

    def late(m, **changes):
        if not turns:
            turns.append(a.insert(rows(spark, "3")))
        commit(m, **changes)

    b._commit = late
    assert b.insert(rows(spark, "3", "4")) == 1 and turns == [1]
    assert set(states(a)) == {"1", "2", "3", "4"}


def test_a_log_of_many_changes_is_written_anew_and_old_files_go(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "q"), keep_below=3)
    store.insert(rows(spark, "1", "2", "3"))
    reader = store.read()
    for n in range(4):
        store.put(store.states().where("id < '3'").withColumn("attempt_count", F.lit(n)))
        if n == 1:
            assert len(store.manifest()["log"]) == 1 and reader.count() == 3  # a reader of before goes on
    m = store.manifest()
    assert len(m["log"]) == 1 and m["changes"] == 0
    assert {r.id: (r.attempt_count, r.payload) for r in store.read().collect()} == {"1": (3, "payload 1"), "2": (3, "payload 2"), "3": (0, "payload 3")}
    store.put(store.states().where("id = '1'"), gone=True)
    store.insert(rows(spark, "1").withColumn("payload", F.lit("again")))
    store.compact()
    m = store.manifest()
    assert set(map(str.strip, m["log"] + m["unused"])) == {f"{tmp_path}/q/log/{x.split('/')[-1]}" for x in glob.glob(str(tmp_path / "q/log/*"))}
    assert len(glob.glob(str(tmp_path / "q/manifest/*.json"))) == 2
    assert states(store) == {"1": ("pending", "again"), "2": ("pending", "payload 2"), "3": ("pending", "payload 3")}
    store.keep(store.read())
    store.forget()
    assert not glob.glob(str(tmp_path / "q/kept"))
