"""The queue on plain Parquet: each change writes a new generation, and a small pointer file names the valid one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from usagelake.operators.dedupe import insert_ignore
from usagelake.schema import QUEUE


class GenerationStore:
    """One writer at a time; readers always see a whole generation. Works on any file system Spark writes to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _valid(self) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        # Pointers are numbered; the greatest one is valid, so a half-done swap leaves the old one in force.
        return self.spark.read.text(f"{self.root}/pointer").orderBy("value", ascending=False).first()[0].split(" ", 1)[1]

    def read(self) -> DataFrame:
        valid = self._valid()
        return self.spark.read.schema(QUEUE).parquet(valid) if valid else self.spark.createDataFrame([], QUEUE)

    def replace(self, queue: DataFrame) -> None:
        path = f"{self.root}/generation-{uuid.uuid4().hex}"
        queue.write.parquet(path)
        pointer = f"{self.root}/pointer"
        valid = self._valid()
        number = 0 if valid is None else int(self.spark.read.text(pointer).orderBy("value", ascending=False).first()[0].split(" ", 1)[0]) + 1
        self.spark.createDataFrame([(f"{number:020d} {path}",)], "value string").coalesce(1).write.mode("append").text(pointer)

    def version(self) -> int | None:
        return None

    def states(self) -> DataFrame:
        return self.read()

    def with_payload(self, rows: DataFrame, narrow: bool = False) -> DataFrame:
        return rows

    def insert(self, rows: DataFrame) -> None:
        """Rows whose id isn't there yet, the first of each."""
        queue = self.read()
        self.replace(queue.unionByName(insert_ignore(queue, rows, "id", ["ts"])))

    def put(self, rows: DataFrame, gone: bool = False, since: int | None = None) -> None:
        """New states of rows that are there, or their end."""
        others = self.read().join(rows.select("id"), "id", "left_anti")
        self.replace(others if gone else others.unionByName(rows))

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a table of its own, so that it stays what it is when the queue changes."""
        path = f"{self.root}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
