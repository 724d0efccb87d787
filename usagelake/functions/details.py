"""Token details that list counts by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of token counts.
KINDS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens", "cache_creation": "cache_creation_input_tokens"}


def split_details(details: Column) -> Column:
    """Struct of summed counts by kind, of an array<struct(tokenType, count)>; null if it lists a kind that is unknown."""
    odd = F.exists(details, lambda d: ~F.coalesce(d["tokenType"], F.lit("")).isin(*KINDS))

    def total(column: str) -> Column:
        kinds = [k for k, c in KINDS.items() if c == column]
        return F.aggregate(F.filter(details, lambda d: d["tokenType"].isin(*kinds)), F.lit(0).cast("long"), lambda a, d: a + d["count"])

    return F.when(~odd & (F.size(details) > 0), F.struct(*[total(c).alias(c) for c in dict.fromkeys(KINDS.values())]))
