"""Schemas of the event table, the export queue and the scan state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.ids import COUNTERS

USAGE = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
FILES = "array<struct<path:string,lines_added:bigint,lines_removed:bigint>>"
COLUMNS = {
    "provider": "string", "id": "string", "source_type": "string", "event_kind": "string", "source_file": "string", "source_line": "int",
    "source_start": "bigint", "source_end": "bigint", "timestamp": "timestamp", "date": "string", "project": "string", "project_path": "string",
    "session_id": "string", "model": "string", "language": "string", "os": "string", "client": "string", "entity": "string", "entity_type": "string",
    "branch": "string", "editor": "string", "category": "string", "is_write": "boolean", "lines_added": "bigint", "lines_removed": "bigint",
    "files": FILES, "raw": "map<string,string>", "usage": USAGE,
}
USAGE_EVENT = ", ".join(f"`{n}` {t}" for n, t in COLUMNS.items())
QUEUE = "id string, ts bigint, payload string, status string, attempt_count int, next_attempt_at bigint, uploaded_at bigint, last_error string, lease_until bigint"
SCAN_STATE = "path string, size bigint, mtime_ns bigint, offset bigint"


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], USAGE_EVENT)


def as_events(rows: DataFrame) -> DataFrame:
    """rows in the shape of the event table: absent columns empty or zero, is_write and timestamps null."""
    have = set(rows.columns)

    def blank(name: str, kind: str):
        if name in ("is_write", "timestamp", "raw"):
            return F.lit(None).cast(kind)
        if kind == "string":
            return F.lit("Unknown" if name == "language" else "")
        if kind in ("int", "bigint"):
            return F.lit(0).cast(kind)
        if name == "files":
            return F.array().cast(kind)
        return F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTERS])

    def own(name: str, kind: str):
        value = F.col(name).cast(kind)
        return F.coalesce(value, blank(name, kind)) if name not in ("is_write", "timestamp", "raw") else value

    return rows.select(*[(own(n, k) if n in have else blank(n, k)).alias(n) for n, k in COLUMNS.items()])
