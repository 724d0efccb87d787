"""Fields of dynamic JSON, read from variant columns with the rules for loose types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.binding import let, settled
from usagelake.functions.text import first_non_empty
from usagelake.functions.times import parse_timestamp
from usagelake.functions.tokens import counter, first_positive


def parsed(text: Column) -> Column:
    """The JSON object of a text as a variant; null for malformed text and for anything but an object."""
    return F.when(text.rlike(r"^[\s\x{FEFF}]*\{"), F.try_parse_json(text))


def records(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows whose text holds a JSON object, with it as v; each text is parsed once."""
    return settled(rows, "v", parsed(F.col(text))).where("v is not null")


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, *paths: str) -> Column:
    """The first path that holds a non-blank string or a number, trimmed; "" if none does."""
    return first_non_empty(*[_plain(v, p) for p in paths])


def _plain(v: Column, path: str) -> Column:
    """A string or number as text, else null."""
    return let(F.try_variant_get(v, path, "variant"), lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|BOOLEAN|VOID)"), F.try_variant_get(x, "$", "string")))


def count(v: Column, *paths: str) -> Column:
    """The first path that holds a counter above 0; else 0."""
    return first_positive(*[counter(_plain(v, p)) for p in paths])


def time(v: Column, *paths: str) -> Column:
    """The first path that holds a timestamp."""
    return F.coalesce(*[parse_timestamp(text(v, p)) for p in paths])


def array(v: Column, path: str) -> Column:
    """An array of variants; empty where the path holds none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
