"""SQLite databases as rows: opened read-only, one task for each file, all cells as text."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a batch, which goes to Spark as columns.
BATCH_ROWS = 2000


def cell(value: object) -> str | None:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else repr(value) if isinstance(value, float) else str(value)


class Database(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.table = json.loads(options["paths"]), options["table"]
        self.columns, self.where = json.loads(options["columns"]), options.get("where", "")

    def partitions(self) -> list[Database]:
        return [Database(p) for p in self.paths]

    def read(self, partition: Database) -> Iterator[pa.RecordBatch]:
        db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            have = {r[1].lower() for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            if not have:
                return  # a table that isn't there has no rows
            picked = ", ".join(f'"{c}"' if c.lower() in have else "''" for c in self.columns)
            rows, number = db.execute(f'SELECT {picked} FROM "{self.table}"' + (f" WHERE {self.where}" if self.where else "")), 0
            while some := rows.fetchmany(BATCH_ROWS):
                n = len(some)
                cells = [pa.array([v if type(v) is str else cell(v) for v in column], pa.string()) for column in zip(*some, strict=True)]
                numbers = pa.array(range(number, number + n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), numbers, *cells], ["path", "row", *self.columns])
                number += n
        except sqlite3.OperationalError as e:
            # A column that a condition needs may be missing; an error while rows are read must not pass for their end.
            if "no such column" not in str(e):
                raise
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "path string, row bigint, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options))


def read_table(spark: SparkSession, paths: list[str], table: str, columns: list[str], where: str = "") -> DataFrame:
    """path, row (place in the scan) and the columns as text; a column the table lacks is empty."""
    if not paths:
        return spark.createDataFrame([], "path string, row bigint, " + ", ".join(f"`{c}` string" for c in columns))
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").options(paths=json.dumps(sorted(set(paths))), table=table, columns=json.dumps(columns), where=where).load()
