"""Bounded samples of labelled documents, for operators that fit a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sampled_ids(labels: DataFrame, label: str, modulus: int, held: int, rows_per_class: int, rows_of_zero: int | None = None) -> DataFrame:
    """doc_id, label: for each class at most rows_per_class (of class 0, rows_of_zero) labelled ids
    outside the held-out share, by least hash.

    An id with several labels counts once, with the least; ids or labels that are null are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return usable.where("label = 0").orderBy(*order).limit(rows_of_zero or rows_per_class).unionAll(usable.where("label = 1").orderBy(*order).limit(rows_per_class))
