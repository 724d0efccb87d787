"""Timestamps as column expressions; all are instants, shown in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.binding import let

# Scalars from these sizes on are nanoseconds, microseconds, milliseconds, else seconds.
NANOS, MICROS, MILLIS = 10**17, 10**14, 10**11
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"


def from_scalar(value: Column) -> Column:
    """Timestamp of a whole number whose size tells its unit; null for 0 and less."""
    return let(value.cast("decimal(20,0)"), _from_scalar)


def _from_scalar(v: Column) -> Column:
    millis = F.when(v >= NANOS, F.floor(v / 1_000_000)).when(v >= MICROS, F.floor(v / 1_000)).when(v >= MILLIS, v).otherwise(v * 1_000)
    return F.when(v > 0, F.timestamp_millis(F.least(millis.cast("decimal(24,0)"), F.lit(253402300799999).cast("decimal(24,0)")).cast("long")))


def from_float(value: Column) -> Column:
    return let(value.cast("double"), _from_float)


def _from_float(v: Column) -> Column:
    usable = (v > 0) & ~F.isnan(v) & (v < 9e15)
    return F.when(usable, F.timestamp_millis(F.when(v < MILLIS, F.floor(v * 1000)).otherwise(F.floor(v)).cast("long")))


def from_parts(seconds: Column, nanos: Column) -> Column:
    """Timestamp of [seconds, nanoseconds], to the millisecond."""
    return F.when(seconds > 0, F.timestamp_millis(seconds * 1000 + F.floor(nanos / 1_000_000)))


def parse_timestamp(text: Column) -> Column:
    """A strict RFC 3339 text, else a number by from_scalar or from_float, else null."""
    return let(F.trim(text), _parse_timestamp)


def _parse_timestamp(t: Column) -> Column:
    whole, number = t.rlike(r"^\+?\d{1,20}$"), t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(t.rlike(RFC3339), F.try_to_timestamp(t)).when(whole, from_scalar(F.when(whole, t).cast("decimal(20,0)"))).when(number, from_float(F.when(number, t).cast("double")))


def rfc3339_nano(ts: Column) -> Column:
    """UTC text with as many fraction digits as needed."""
    text = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.substring(text, 1, 19), F.regexp_replace(F.substring(text, 20, 7), r"\.?0+$", ""), F.lit("Z"))


def local_date(ts: Column, zone: str) -> Column:
    """Calendar date at a zone, as yyyy-MM-dd."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


# Fixed value: what a line says of a limit, before a bar and the second at which it ends.
LIMIT_REACHED = "Claude AI usage limit reached"


def limit_reset(line: Column, is_error: Column) -> Column:
    """When the limit that an error line tells of ends, null if it tells of none: digits right after the first bar that follows the first mention."""
    told = F.regexp_extract(F.substring(line, F.locate(LIMIT_REACHED, line), F.length(line)), r"^[^|]*\|([0-9]+)", 1).try_cast("bigint")
    return F.when(F.coalesce(is_error, F.lit(False)) & line.contains(LIMIT_REACHED) & told.between(1, 253402300799), F.timestamp_seconds(told))


def backoff_seconds(attempts: Column) -> Column:
    """Delay after a failure, by the failures before it: 30 s doubling, an hour at most."""
    return F.least(F.call_function("shiftleft", F.lit(30).cast("long"), F.least(attempts, F.lit(7)).cast("int")), F.lit(3600).cast("long"))
