"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which stands once in the expression however often body uses it: expressions that are put into
    one another would double with each use else."""
    return F.transform(F.array(value), body)[0]


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row. Conditions on it stay above it; a plain column's expression would be
    put into them, as often as they use it, and be computed once more for each."""
    return rows.withColumn(name, F.explode(F.array(value)))
