"""Token counters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.binding import let
from usagelake.functions.ids import COUNTERS

BUCKETS = COUNTERS[:-1]
MOST = 2**63 - 1


def counter(text: Column) -> Column:
    """A counter from text: whole, or a number cut toward zero; 0 for all else, at most a long."""
    return let(F.trim(text), _counter)


def _counter(t: Column) -> Column:
    whole, number = t.rlike(r"^\d{1,30}$"), t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    exact = F.when(whole, t).try_cast("decimal(30,0)")
    cut = F.when(number & ~whole, F.floor(F.greatest(F.least(F.when(number, t).try_cast("double"), F.lit(9.2e18)), F.lit(0.0))))
    return F.coalesce(F.least(F.coalesce(exact, cut.cast("decimal(30,0)")), F.when(number, F.lit(MOST)).cast("decimal(30,0)")).cast("long"), F.lit(0).cast("long"))


def first_positive(*values: Column) -> Column:
    """The first value above 0, so that a 0 falls through to the next alias; else 0."""
    return F.coalesce(*[let(v, lambda x: F.when(x > 0, x)) for v in values], F.lit(0)).cast("long")


def bucket_sum(tokens: Column) -> Column:
    return sum((tokens[b] for b in BUCKETS[1:]), tokens[BUCKETS[0]])


def usage(input_: Column | int = 0, output: Column | int = 0, cache_creation: Column | int = 0, cache_read: Column | int = 0, cached: Column | int = 0, reasoning: Column | int = 0, total: Column | int = 0) -> Column:
    values = (input_, output, cache_creation, cache_read, cached, reasoning, total)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(c) for c, v in zip(COUNTERS, values, strict=True)])


def apply_total(tokens: Column, total: Column) -> Column:
    """Reconciles buckets with a reported total: all of it is output if no bucket is known; what it has beyond the
    buckets is reasoning; without one the buckets' sum is the total."""
    return let(F.struct(tokens.alias("t"), total.alias("n")), lambda s: let(F.struct(s["t"].alias("t"), s["n"].alias("n"), bucket_sum(s["t"]).alias("known")), lambda x: _apply_total(x["t"], x["n"], x["known"])))


def _apply_total(tokens: Column, total: Column, known: Column) -> Column:
    only, more = (known == 0) & (total > 0), total > known
    return F.struct(
        *[tokens[c].alias(c) for c in ("input_tokens",)],
        F.when(only, total).otherwise(tokens["output_tokens"]).alias("output_tokens"),
        *[tokens[c].alias(c) for c in ("cache_creation_input_tokens", "cache_read_input_tokens", "cached_input_tokens")],
        F.when(~only & more, tokens["reasoning_output_tokens"] + total - known).otherwise(tokens["reasoning_output_tokens"]).alias("reasoning_output_tokens"),
        F.when(only | more, total).when(tokens["total_tokens"] == 0, known).otherwise(tokens["total_tokens"]).alias("total_tokens"),
    )


def non_zero(tokens: Column) -> Column:
    return let(tokens, lambda t: (bucket_sum(t) > 0) | (t["total_tokens"] > 0))
