"""State across micro-batches: lines that belong to one row of a file are held until all of them are there.

A segment is a line that opens one (a usage row) with the lines that follow it (its file changes) up to the next opening line of its file; lines before
the first one belong to its segment. A micro-batch ends anywhere, so a segment's lines may come with several. The state holds each file's open segment
and lets it go whole, so what parses a micro-batch by itself finds for each row what it finds in the whole file.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE = "path string, mtime timestamp, line int, start bigint, stop bigint, value string"
NAMES = [c.split(" ")[0] for c in LINE.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(lines: list[Any]) -> Iterator[Row]:
    """Each position once, with the line read last: a line is read again once its line feed is there."""
    latest = {r[3]: r for r in lines}
    return (Row(**dict(zip(NAMES, latest[at]))) for at in sorted(latest))


class Segments(StatefulProcessor):
    """Per file: the lines of the open segment (held), and where it opens, where its first line begins and the timer that lets it go (mark)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", LINE)
        self.mark = handle.getValueState("mark", "opened bigint, least bigint, timer bigint")

    def taken(self) -> list[Any]:
        lines = list(self.held.get()) if self.held.exists() else []
        self.held.clear()
        return lines

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        opened, least, timer = self.mark.get() if self.mark.exists() else (None, None, None)
        batch = sorted(rows, key=lambda r: r["start"])
        arrived = max(int(r["arrived_ms"]) for r in batch)
        if least is not None and batch[0]["start"] < least:  # the file began anew
            yield from in_order(self.taken())
            opened, least = None, None
        fresh: list[tuple] = []
        for r in batch:
            if r["opens"]:
                if opened is not None and r["start"] != opened:
                    yield from in_order(self.taken() + fresh)
                    fresh, least = [], None
                opened = r["start"]
            fresh.append(tuple(r[c] for c in NAMES))
            least = r["start"] if least is None else least
        self.held.appendList(fresh)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if opened is None else arrived
        if timer is not None:
            self.handle.registerTimer(timer)
        self.mark.update((opened, least, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        lines = self.taken()
        self.mark.clear()
        yield from in_order(lines)

    def close(self) -> None:
        pass


def whole_segments(lines: DataFrame, hold: str) -> DataFrame:
    """The needed lines (columns needed and opens beside a line's own) of a stream, each segment whole: when the next one of its file opens, or when it got nothing new for the time of hold.

    Time goes by when batches arrive, not by the lines' own stamps: files are read in turn, so stamps of one say nothing of another, and no line is ever
    late. A segment that is due goes with the next batch that any file brings. What comes after that for a segment that is gone belongs to the next one.
    Memory is that of one file's lines of a batch and of its open segment.
    """
    seen = lines.where("needed").withColumns({"opens": F.coalesce("opens", F.lit(False)), "arrived": F.current_timestamp()}).withWatermark("arrived", hold)
    seen = seen.select(*NAMES, "opens", "arrived", F.unix_millis("arrived").alias("arrived_ms"))
    return seen.groupBy("path").transformWithState(Segments(), LINE, "append", "eventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query started within keeps its state in RocksDB, as such state must be; the session's own setting is left as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def held_lines(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The lines that a query with this checkpoint holds, as its last batch left them."""
    with state_in_rocksdb(spark):
        rows = spark.read.format("statestore").option("stateVarName", "held").option("flattenCollectionTypes", True).load(checkpoint)
    value = F.col("list_element")
    lines = rows.select(*[value[c].alias(c) for c in NAMES])
    return lines.dropDuplicates(["path", "start", "stop"])
