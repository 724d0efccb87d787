"""Connected components of edge tables, by alternating star contraction; only DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from usagelake.llm.common import replaced, written


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _one_round(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return _with_least(large).select(ends.alias("e")).select("e.*").where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable, for each node of an edge table of two long columns.

    Every round hangs each node's larger neighbours onto its least one (large star), then each node and its
    smaller neighbours (small star); it ends when the edges stay the same. Edges never meet in one task
    but for sums and minima by node, made partially before the shuffle; a hot node only makes a skewed join.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = written(e, "edges"), None
    for _ in range(max_rounds):
        seen_in = Observation()
        e = replaced(e, _one_round(e).observe(seen_in, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        now = seen_in.get["n"], seen_in.get["sum"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
