"""Which of several sources' rows count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.operators.dedupe import survivor


def suppress_lower(rows: DataFrame, scope: list[str], ids: list[str], level: str) -> DataFrame:
    """Drops rows that share one of ids (empty ones don't count) with a row of a lower level number in the scope."""
    keep = F.lit(True)
    for name in ids:
        least = F.min(level).over(Window.partitionBy(*scope, name))
        keep = keep & ((F.col(name) == "") | (F.col(level) <= least))
    return rows.withColumn("_keep", keep).where("_keep").drop("_keep")


def without_twins(rows: DataFrame, others: DataFrame, keys: list[str], time: str, micros: int) -> DataFrame:
    """Rows that no row of others equals in all keys within so many microseconds, inclusive."""
    o = others.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("_time"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    apart = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_time").cast("timestamp")))
    return rows.join(o, same & (apart <= micros), "left_anti")


def preferred_union(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both, those of first before those of second where keys are equal."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    return survivor(both, keys, [F.col("_from").asc(), *[F.col(c).asc() for c in order]]).drop("_from")


def unacknowledged(sent: DataFrame, *acknowledged: DataFrame) -> DataFrame:
    """Rows of sent whose id is in none of the replies."""
    known = reduce(DataFrame.unionByName, [a.select("id") for a in acknowledged]).distinct()
    return sent.join(known, "id", "left_anti")


def ancestor_marks(rows: DataFrame, path: Column, marks: DataFrame, key: list[str], kinds: dict[str, Column]) -> DataFrame:
    """key and a struct for each of kinds: the mark (dir, ...) in the nearest directory at or above path for which the kind's
    condition holds, null without one. Rows without any mark are left out."""
    from usagelake.functions.paths import ancestors

    steps = rows.select(*key, F.posexplode(ancestors(path)).alias("_height", "dir")).join(marks, "dir")
    nearest = [F.min_by(F.struct(*marks.columns), F.when(holds, F.col("_height"))).alias(kind) for kind, holds in kinds.items()]
    return steps.groupBy(*key).agg(*nearest)


def nearest_ancestor(rows: DataFrame, path: Column, marks: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns of the mark (dir, ...) in the nearest directory at or above path; null without one."""
    found = ancestor_marks(rows, path, marks, key, {"_mark": F.lit(True)})
    return rows.join(found.select(*key, "_mark.*"), key, "left")
