"""Daily summaries of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.functions.ids import COUNTERS

KEYS = ("provider", "date", "project", "project_path")


def daily_project_summary(events: DataFrame) -> DataFrame:
    """Sums of all counters by provider, date, project and project path, in a total order."""
    sums = events.groupBy(*KEYS).agg(*[F.sum(f"usage.{c}").cast("long").alias(c) for c in COUNTERS])
    return sums.orderBy("provider", "project", "date", "project_path")


def daily_totals(events: DataFrame) -> DataFrame:
    """One provider's days and projects, the total being the sum of its four billed buckets."""
    billed = F.col("usage.input_tokens") + F.col("usage.output_tokens") + F.col("usage.cache_creation_input_tokens") + F.col("usage.cache_read_input_tokens")
    return events.groupBy("date", "project").agg(F.sum(billed).cast("long").alias("total_tokens"), F.count("*").alias("entries")).orderBy("date", "project")


def latest_snapshots(events: DataFrame) -> DataFrame:
    """An extension: of sources that store running session totals, the newest row of each session."""
    from usagelake.operators.dedupe import survivor

    return survivor(events, ["provider", "session_id"], [F.desc("timestamp"), F.asc("id")])


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """An extension: activity sessions of each project by event time."""
    spans = events.groupBy("provider", "project", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("usage.total_tokens").cast("long").alias("total_tokens"))
    return spans.select("provider", "project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total_tokens")


def summary_cube(events: DataFrame) -> DataFrame:
    """An extension: totals by provider and project with all subtotals."""
    return events.cube("provider", "project").agg(F.sum("usage.total_tokens").cast("long").alias("total_tokens"), F.countDistinct("session_id").alias("sessions"), F.grouping_id().alias("level"))
