"""Operators over rows in the order of their source: carries, counter deltas and attribution.

All run as windows over the rows of one source (a file or session), so sources spread over the cluster
and Spark sorts each once; a chain of them with equal partitioning shares one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def up_to_here(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def all_of(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def from_here(keys: list[str], order: list[str]) -> WindowSpec:
    """The rows from the row on, last first. A frame that begins at the row and ends with the source is evaluated anew for
    each row, so its cost would grow with the square of a source's rows."""
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(value: Column, keys: list[str], order: list[str]) -> Column:
    """The latest non-empty value at or before the row; "" before the first."""
    return F.coalesce(F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(up_to_here(keys, order)), F.lit(""))


def final_value(value: Column, keys: list[str], order: list[str]) -> Column:
    """The latest non-empty value of the whole source."""
    return F.coalesce(F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(all_of(keys, order)), F.lit(""))


def counter_deltas(rows: DataFrame, keys: list[str], order: list[str], total: str, last: str, fields: list[str], out: str = "delta") -> DataFrame:
    """Bills cumulative counters by their growth.

    total and last are struct columns of fields, total null where a row has none. The first total is billed whole;
    later ones by their growth if no field went back, else by last; rows without growth are dropped,
    yet count as the previous total. Rows without total are billed by last and leave the previous total as it is.
    """
    previous = F.last(total, ignorenulls=True).over(before_here(keys, order))
    rows = rows.withColumn("_previous", previous)
    forward = F.lit(True)
    for f in fields:
        forward = forward & (F.col(f"{total}.{f}") >= F.col(f"_previous.{f}"))
    billed = F.struct(*[F.when(F.col(total).isNull(), F.col(f"{last}.{f}")).when(F.col("_previous").isNull(), F.col(f"{total}.{f}")).when(forward, F.col(f"{total}.{f}") - F.col(f"_previous.{f}")).otherwise(F.col(f"{last}.{f}")).alias(f) for f in fields])
    grown = F.lit(False)
    for f in fields:
        grown = grown | (F.col(f"{total}.{f}") > F.col(f"_previous.{f}"))
    kept = F.col(total).isNull() | F.col("_previous").isNull() | ~forward | grown
    return rows.withColumn(out, billed).where(kept).drop("_previous")


def growth(value: Column, keys: list[str], order: list[str]) -> Column:
    """Growth of a running counter since the row before; a counter that didn't grow is billed whole."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(previous.isNull() | (value <= previous), value).otherwise(value - previous)


def attributed_to(is_target: Column, target: Column, keys: list[str], order: list[str], following_only: bool = False) -> Column:
    """The target row at or before the row, else the first after it; with following_only, the next one alone."""
    own = F.when(is_target, target)
    return F.last(own, ignorenulls=True).over(from_here(keys, order)) if following_only else latest_or_first(own, keys, order)


def latest_or_first(value: Column, keys: list[str], order: list[str]) -> Column:
    """The latest value at or before the row; before the first value, that one, which is then the first of all the source."""
    return F.coalesce(F.last(value, ignorenulls=True).over(up_to_here(keys, order)), F.first(value, ignorenulls=True).over(all_of(keys, order)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, tie: str, out: str) -> DataFrame:
    """left with the value of the latest right row at or before it, else of the first right row of the keys.

    Both sides are put in one sequence, so the join is one shuffle and sort whatever the number of matches.
    """
    l = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    r = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_value"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    order = ["_time", "_side", "_tie"]
    return l.unionByName(r).withColumn(out, latest_or_first(F.col("_value"), keys, order)).where("_side = 1").select("_row.*", out)
