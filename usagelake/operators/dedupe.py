"""Survivors of groups, each by a total order, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivor(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by order; null keys form a group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return survivor(rows, keys, [F.col(c).asc() for c in order])


def last_wins(rows: DataFrame, keys: list[str], order: list[str], position: str = "position") -> DataFrame:
    """The last row of each group, with the place of the group's first row as position (the first order column)."""
    spread = Window.partitionBy(*keys)
    return survivor(rows.withColumn(position, F.min(order[0]).over(spread)), keys, [F.col(c).desc() for c in order])


def keep_best(rows: DataFrame, keys: list[str], weight: Column, preferred: Column, order: list[str]) -> DataFrame:
    """The heaviest row of each group; on a tie one that is preferred, then the first."""
    return survivor(rows, keys, [weight.desc(), F.coalesce(preferred, F.lit(False)).desc(), *[F.col(c).asc() for c in order]])


def insert_ignore(existing: DataFrame, batch: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Rows of batch whose key isn't stored yet, the first of each key. An empty key fails the whole batch."""
    checked = batch.withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.lit("event without id"))).otherwise(F.col(key)))
    return first_wins(checked.join(existing.select(key), key, "left_anti"), [key], order or [key])


def rekey(rows: DataFrame, new_key: str, status: str, order: list[str]) -> DataFrame:
    """One row of each new key: uploaded before rejected before others, then the first."""
    rank = F.when(F.col(status) == "uploaded", 3).when(F.col(status) == "rejected", 2).otherwise(1)
    return survivor(rows, [new_key], [rank.desc(), *[F.col(c).asc() for c in order]])
