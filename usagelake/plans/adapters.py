"""Views of the driver's tables in the shape of events, patches, queues and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.tokens import usage


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def k_of(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage rows: counters from value and k."""
    e = k_of(read(spark, sf_dir, "events"))
    project = F.concat(F.lit("p"), (F.col("k") % 7).cast("string"))
    input_, total = F.floor("value").cast("long"), F.floor("value").cast("long") + F.col("k") + F.col("k") % 5 + F.col("k") % 3
    return e.select(
        F.col("event_type").alias("provider"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        project.alias("project"),
        F.concat(F.lit("/work/"), project).alias("project_path"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("k"),
        usage(input_, F.col("k"), 0, F.col("k") % 5, 0, F.col("k") % 3, total).alias("usage"),
    )


def counter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of each user, which restart at each error; every fourth event repeats k = 0."""
    from pyspark.sql import Window

    e = k_of(read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")).withColumn("k", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("k")))
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("epoch", F.sum((F.col("event_type") == "error").cast("int")).over(so_far))
    in_epoch = Window.partitionBy("user_id", "epoch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("running", F.sum("k").over(in_epoch).cast("long")).select("user_id", "event_id", "event_type", "k", "epoch", "running")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as file changes of an order."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".go", ".py", ".h", ".cpp", ".md")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    item = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return item.select(F.col("l_orderkey").alias("entry"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.concat(F.lit("src/f"), (F.col("l_partkey") % 20).cast("string"), ends).alias("path"), F.col("l_quantity").cast("long").alias("lines_added"), F.col("l_linenumber").cast("long").alias("lines_removed"))


PATCH_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

NOW = 900_000_000


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as an export queue around NOW."""
    o = read(spark, sf_dir, "orders")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "failed", "sending", "uploaded", "rejected")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        ts.alias("ts"),
        F.lit("{}").alias("payload"),
        status.alias("status"),
        (F.col("o_custkey") % 10).cast("int").alias("attempt_count"),
        (F.lit(NOW) + (F.col("o_custkey") % 7 - 3) * 100).cast("long").alias("next_attempt_at"),
        F.when(status == "uploaded", ts).cast("long").alias("uploaded_at"),
        F.lit("").alias("last_error"),
        F.when(status == "sending", F.lit(NOW) + (F.col("o_custkey") % 3 - 1) * 10).otherwise(0).cast("long").alias("lease_until"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a transcript: assistant turns are usage rows, user turns patches."""
    c = read(spark, sf_dir, "conversations")
    length = F.length(F.coalesce("text", F.lit("")))
    model = F.when(length % 3 == 0, F.concat(F.lit("m"), (length % 4).cast("string"))).otherwise("")
    # A turn may repeat: rows with equal conv_id, turn and role count once.
    return c.select("conv_id", "turn", "role", length.cast("long").alias("n"), model.alias("model")).groupBy("conv_id", "turn", "role").agg(F.min("n").alias("n"), F.min("model").alias("model")).withColumn("at", F.col("turn") * 4 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2))
