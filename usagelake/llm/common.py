"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Number of hash cells that a large group is cut into before it is ordered or summed (three hex digits).
CELLS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none and all of Spark is on this machine (a test) is a temporary folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="usagelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.parquet(path)
    table.written_at = path
    if _open:
        _open[-1].tables.append(table)
    return table


class Scratch:
    """Tables written while it is open; they go when it closes, but for those that are kept."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table


_open: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """For steps whose result is a written table: what else they write is deleted at their end, and Spark frees their shuffle
    files once the driver has forgotten their plans. What is kept belongs to the steps around, if those are in a scratch, too."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
    if _open:
        _open[-1].tables += own.kept
    spark = own.kept[0].sparkSession if own.kept else None
    kept = {t.written_at for t in own.kept}
    dropped(*[t for t in own.tables if t.written_at not in kept])
    own.tables.clear()
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def replaced(old: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """df, made from the written table old, written in its turn; old goes, and so do the shuffle files that only it
    and df's own plan needed, which Spark frees once the driver has forgotten their plans."""
    new = written(df, name)
    spark = df.sparkSession
    dropped(old)
    del df, old
    gc.collect()
    spark._jvm.System.gc()
    return new


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for one in tables:
        spark = one.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(one.written_at)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns called like one of names, in any letter case (an operator's own columns win)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_cell(digest: Column) -> Column:
    """The first three hex digits of a digest: one of CELLS cells whose order agrees with the digest's."""
    return F.substring(digest, 1, 3)


def before(df: DataFrame, group: list[str], cell: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the same group that come earlier by (cell, order).

    The group is cut into cells: one task orders one cell, and only a row for each cell is summed over
    the group, so a group with a third of all rows spreads over all tasks.
    """
    inner = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*group, cell).agg(F.sum(value).alias("_cell_sum"))
    cells = cells.select(*group, cell, F.coalesce(F.sum("_cell_sum").over(outer), F.lit(0)).alias("_cell_before"))
    rows = df.withColumn("_row_before", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(cells, [*group, cell]).withColumn(name, F.col("_cell_before") + F.col("_row_before")).drop("_cell_before", "_row_before")


#: Bits of the bitmap that prefilters rows before a join; its 1024 pieces of 4 KB are all that is broadcast.
FILTER_BITS = 2**25


def prefiltered(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key may be among the wanted keys: all that are, and some others by chance.

    For use before a join that would shuffle wide rows most of which match nothing. Keys are hashed onto a bitmap of
    fixed size; on inputs that fill it up less is held back, and the join stays right.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place(wanted_key).alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    position = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_place", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(bits), "_bucket")
    return found.where(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("_place", "_bucket", "_bits")
