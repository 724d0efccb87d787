"""Line counts of patches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff_counts(diff: Column) -> Column:
    """struct(lines_added, lines_removed) of a unified diff; its file headers don't count."""
    lines = F.split(diff, "\n")
    marked = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return F.struct(marked("+").alias("lines_added"), marked("-").alias("lines_removed"))


def hunk_counts(lines: Column) -> Column:
    """The same for an array of hunk lines, by their first character alone."""
    marked = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign))).cast("long")
    return F.struct(marked("+").alias("lines_added"), marked("-").alias("lines_removed"))


def envelope_changes(text: Column, needs_begin: bool = True) -> Column:
    """array<struct(path, lines_added, lines_removed)> of an apply-patch envelope, in order.

    A file starts at an Add, Update or Delete line; a Move line renames it; other directive lines count for none.
    With needs_begin, all before the begin mark is skipped and an envelope without it has no changes.
    """
    change = "array<struct<path:string,lines_added:bigint,lines_removed:bigint>>"
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    if needs_begin:
        begin = F.array_position(F.transform(lines, lambda x: F.trim(x)), "*** Begin Patch")
        lines = F.when(begin > 0, F.slice(lines, (begin + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))

    def step(done: Column, line: Column) -> Column:
        header = F.trim(F.regexp_extract(line, r"^\*\*\* (?:Add|Update|Delete) File: (.*)$", 1))
        moved = F.trim(F.regexp_extract(line, r"^\*\*\* Move to: (.*)$", 1))
        last = F.element_at(done, -1)
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        put = lambda path, added, removed: F.concat(rest, F.array(F.struct(path.alias("path"), added.alias("lines_added"), removed.alias("lines_removed"))))
        new = F.concat(done, F.array(F.struct(header.alias("path"), F.lit(0).cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))))
        return (
            F.when(header != "", new)
            .when(F.size(done) == 0, done)
            .when(moved != "", put(moved, last["lines_added"], last["lines_removed"]))
            .when(line.startswith("***"), done)
            .when(line.startswith("+"), put(last["path"], last["lines_added"] + 1, last["lines_removed"]))
            .when(line.startswith("-"), put(last["path"], last["lines_added"], last["lines_removed"] + 1))
            .otherwise(done)
        )

    return F.aggregate(lines, F.array().cast(change), step)
