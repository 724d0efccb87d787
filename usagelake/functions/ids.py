"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.times import rfc3339_nano

COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "cached_input_tokens", "reasoning_output_tokens", "total_tokens")


def stable_id(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by a null character; a null part counts as empty, so none is skipped."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_entry_id(*extra: Column) -> Column:
    """Identity of an event row by its place in the source and its content."""
    own = [F.col("provider"), F.col("source_file"), F.col("source_start"), rfc3339_nano(F.col("timestamp")), F.col("project"), F.col("project_path"), F.col("session_id"), F.col("model")]
    return stable_id(*own, *[F.col(f"usage.{c}") for c in COUNTERS], *extra)
