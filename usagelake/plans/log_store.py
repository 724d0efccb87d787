"""The queue as a log of changed rows on Parquet: a change writes the rows it changes, and the latest state of each id counts.

The log is a list of folders, named in order by a numbered manifest. Inserts hold whole rows; changes hold a row's state without its payload, which
never changes. Who claims reads states alone, and payloads are read for what was claimed, by the claim's range of times. A manifest is put in place by a rename
that fails if its number is taken: of two writers that start from one state the second gets a Conflict and has changed nothing. Once the log holds more changes
than rows it is written anew as one folder; what it replaces goes when that happens the next time, so readers aren't cut off.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.operators.dedupe import insert_ignore
from usagelake.schema import QUEUE

LOG = f"{QUEUE}, version bigint, gone boolean"
COLUMNS = [c.split(" ")[0] for c in QUEUE.split(", ")]
STATE = [c for c in COLUMNS if c != "payload"]
#: How often a change that doesn't depend on a version is tried when others write at the same time.
TURNS = 5
EMPTY = {"version": 0, "log": [], "inserts": [], "rows": 0, "changes": 0, "unused": []}


class Conflict(Exception):
    """Another writer changed the queue in the meantime."""


class LogStore:
    """Queue rows by id on any file system Spark writes to. A queue of fewer than keep_below rows isn't written anew for its changes' sake."""

    def __init__(self, spark: SparkSession, root: str, keep_below: int = 100_000) -> None:
        self.spark, self.root, self.keep_below = spark, root.rstrip("/"), keep_below
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(self.root).getFileSystem(self.conf)

    # manifests

    def _path(self, version: int) -> str:
        return f"{self.root}/manifest/{version:020d}.json"

    def manifest(self) -> dict:
        found = self.fs.globStatus(self.hadoop.Path(f"{self.root}/manifest/*.json"))
        if not found:
            return dict(EMPTY)
        stream = self.fs.open(max((f.getPath() for f in found), key=lambda p: p.getName()))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, **changes) -> None:
        after = {**before, **changes, "version": before["version"] + 1}
        draft, place = self.hadoop.Path(f"{self.root}/manifest/{uuid.uuid4().hex}.draft"), self.hadoop.Path(self._path(after["version"]))
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        rename = getattr(self.hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.hadoop.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, place, how)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {after['version']} of {self.root} was written by another") from e
            raise

    def _write(self, rows: DataFrame, version: int, gone: bool = False) -> tuple[str, int]:
        folder = f"{self.root}/log/{uuid.uuid4().hex}"
        have = set(rows.columns)
        payload = F.col("payload") if "payload" in have else F.lit(None).cast("string")
        shaped = rows.select(*[payload.alias(c) if c == "payload" else F.col(c) for c in COLUMNS], F.lit(version).cast("long").alias("version"), F.lit(gone).alias("gone"))
        shaped.write.parquet(folder)
        return folder, self.spark.read.schema(LOG).parquet(folder).count()

    # reading

    def states(self) -> DataFrame:
        """Each row without its payload."""
        return self._states(self.manifest())

    def _states(self, m: dict) -> DataFrame:
        if not m["log"]:
            return self.spark.createDataFrame([], QUEUE).drop("payload")
        log = self.spark.read.schema(LOG).parquet(*m["log"]).select(*STATE, "version", "gone")
        if len(m["log"]) > 1:
            rest = [c for c in STATE if c != "id"]
            log = log.groupBy("id").agg(F.max_by(F.struct(*rest, "gone"), "version").alias("s")).select("id", *[F.col(f"s.{c}").alias(c) for c in (*rest, "gone")])
        return log.where("not gone").select(*STATE)

    def with_payload(self, rows: DataFrame, narrow: bool = False) -> DataFrame:
        """rows with their payloads. With narrow, which reads rows twice, only payloads between their first and last time are read."""
        return self._with_payload(rows, self.manifest(), narrow)

    def _with_payload(self, rows: DataFrame, m: dict, narrow: bool = False) -> DataFrame:
        if not m["inserts"]:
            return rows.withColumn("payload", F.lit(None).cast("string")).select(*COLUMNS)
        held = self.spark.read.schema(LOG).parquet(*m["inserts"]).select("id", "ts", "payload", "version")
        if narrow:
            low, high = rows.agg(F.min("ts"), F.max("ts")).first()
            held = held.where(F.col("ts").between(low, high))
        held = held if len(m["inserts"]) == 1 else held.join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by("payload", "version").alias("payload"))
        return rows.join(held.select("id", "payload"), "id", "left").select(*COLUMNS)

    def read(self) -> DataFrame:
        m = self.manifest()
        return self._with_payload(self._states(m), m)

    # changing

    def version(self) -> int:
        return self.manifest()["version"]

    def _append(self, rows: DataFrame, m: dict, whole: bool, gone: bool = False) -> int:
        folder, n = self._write(rows, m["version"] + 1, gone)
        try:
            if n and whole:
                self._commit(m, log=[*m["log"], folder], inserts=[*m["inserts"], folder], rows=m["rows"] + n)
            elif n:
                self._commit(m, log=[*m["log"], folder], changes=m["changes"] + n)
        except Conflict:
            n = 0
            raise
        finally:
            if not n:
                self.fs.delete(self.hadoop.Path(folder), True)
        return n

    def insert(self, rows: DataFrame) -> int:
        """Rows whose id isn't there yet, the first of each; how many there were."""
        for turn in range(TURNS):
            m = self.manifest()
            try:
                return self._append(insert_ignore(self._states(m).select("id"), rows, "id", ["ts"]).sortWithinPartitions("ts"), m, True)
            except Conflict:
                if turn == TURNS - 1:
                    raise

    def put(self, rows: DataFrame, gone: bool = False, since: int | None = None) -> int:
        """New states of rows that are there (their payloads stay), or their end; how many. A Conflict if another has changed the queue since that version."""
        for turn in range(TURNS):
            m = self.manifest()
            if since is not None and m["version"] != since:
                raise Conflict(f"{self.root} has gone on from version {since} to {m['version']}")
            try:
                n = self._append(rows.drop("payload"), m, False, gone)
            except Conflict:
                if since is not None or turn == TURNS - 1:
                    raise
            else:
                break
        if m["changes"] + n > max(m["rows"], self.keep_below):
            self.compact()
        return n

    def replace(self, queue: DataFrame) -> None:
        """The whole queue anew, as one folder."""
        m = self.manifest()
        folder, n = self._write(queue.repartitionByRange("ts").sortWithinPartitions("ts"), m["version"] + 1)
        self._commit(m, log=[folder], inserts=[folder], rows=n, changes=0, unused=m["log"])
        for old in m["unused"]:
            self.fs.delete(self.hadoop.Path(old), True)
        stale = [f.getPath() for f in self.fs.globStatus(self.hadoop.Path(f"{self.root}/manifest/*.json"))]
        for path in sorted(stale, key=lambda p: p.getName())[:-2]:
            self.fs.delete(path, False)

    def compact(self) -> None:
        try:
            self.replace(self.read())
        except Conflict:
            pass  # the next change will see to it

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a table of its own, so that it stays what it is when the queue changes."""
        path = f"{self.root}/kept/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Without the tables that keep made; none of them may be in use."""
        self.fs.delete(self.hadoop.Path(f"{self.root}/kept"), True)
