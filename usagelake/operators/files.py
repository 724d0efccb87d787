"""Roll-ups of file changes into their events, and languages of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelake.functions.language import HEADER_LANGUAGES, UNKNOWN, is_header, language_of
from usagelake.operators.dedupe import survivor


def file_rollup(changes: DataFrame, keys: list[str], order: list[str], tie: str = "last") -> DataFrame:
    """For each event: lines_added and lines_removed of all its changes, files in order of first change (changes
    without path count in totals alone), and entity, the file with most changed lines: on a tie the last or
    the first of files, as tie says; "touched" prefers the file changed latest, then the first."""
    if tie not in ("last", "first", "touched"):
        raise ValueError(f"unknown tie rule {tie}")
    places = changes.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    totals = places.groupBy(*keys).agg(F.sum("lines_added").cast("long").alias("lines_added"), F.sum("lines_removed").cast("long").alias("lines_removed"), F.max("_at").alias("_latest"))
    files = places.where("path <> ''").groupBy(*keys, "path").agg(F.sum("lines_added").cast("long").alias("lines_added"), F.sum("lines_removed").cast("long").alias("lines_removed"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    one = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "path", "lines_added", "lines_removed", "_last"))).alias("_files"))
    weight = lambda f: f["lines_added"] + f["lines_removed"]
    most = F.array_max(F.transform("_files", weight))
    top = F.filter("_files", lambda f: weight(f) == most)
    chosen = F.element_at(top, -1 if tie == "last" else 1)["path"]
    if tie == "touched":
        latest = F.filter(top, lambda f: f["_last"] == F.array_max(F.transform("_files", lambda g: g["_last"])))
        chosen = F.coalesce(F.try_element_at(latest, F.lit(1))["path"], chosen)
    one = one.select(*keys, chosen.alias("entity"), F.transform("_files", lambda f: F.struct(f["path"].alias("path"), f["lines_added"].alias("lines_added"), f["lines_removed"].alias("lines_removed"))).alias("files"))
    null_safe = totals.drop("_latest").join(one, keys, "left")
    return null_safe.withColumn("entity", F.coalesce("entity", F.lit(""))).withColumn("is_write", F.lit(True))


def dominant_language(candidates: DataFrame, keys: list[str], path: str = "path", weight: str = "weight") -> DataFrame:
    """The language with most weight for each event, ties to the alphabetically first; weights under 1 count as 1.

    Headers add to the heaviest of the C family, the earlier in its order on a tie, C without any; events with no
    known language get Unknown.
    """
    scored = candidates.select(*keys, F.when(is_header(F.col(path)), F.lit(".h")).otherwise(language_of(F.col(path))).alias("language"), F.greatest(F.col(weight), F.lit(1)).cast("long").alias("weight"))
    sums = scored.groupBy(*keys, "language").agg(F.sum("weight").cast("long").alias("weight"))
    place = F.array_position(F.array(*[F.lit(x) for x in HEADER_LANGUAGES]), F.col("language"))
    family = survivor(sums.where(F.col("language").isin(*HEADER_LANGUAGES)), keys, [F.col("weight").desc(), place.asc()]).select(*keys, F.col("language").alias("_family"))
    named = sums.join(family, keys, "left").withColumn("language", F.when(F.col("language") == ".h", F.coalesce("_family", F.lit("C"))).otherwise(F.col("language")))
    named = named.groupBy(*keys, "language").agg(F.sum("weight").cast("long").alias("weight"))
    return survivor(named, keys, [(F.col("language") == UNKNOWN).asc(), F.col("weight").desc(), F.col("language").asc()]).select(*keys, "language")


def with_language(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the dominant language of their candidates (keys, path, weight); Unknown without any."""
    found = dominant_language(candidates, keys)
    return rows.drop("language").join(found, keys, "left").withColumn("language", F.coalesce("language", F.lit(UNKNOWN)))
