"""Exact top-k inner-product search with vector-approximation files.

The vectors are packed into pages of at most PAGE vectors. A page keeps, for each vector and dimension, the
number of one of CELLS equal cells between the page's least and greatest value there (the approximation),
and apart from it the exact integers. For a block of at most BLOCK queries and a page, the cells alone give
an upper and a lower bound of every score; vectors whose upper bound is under the kth greatest lower bound
are out, and the others' exact values are read in the order of their upper bounds until the kth score so
far is above all bounds that are left. Each page gives k rows for each query; Spark ranks those.

Memory in a task: one page, one block, and BLOCK x PAGE bounds. Queries are never broadcast.

Defined cases: vectors that are null or hold a null or non-finite component take no part, as query or
candidate; vectors of another length than the query's aren't its candidates; empty vectors score 0; rows with
the same id are different rows, each may be the other's candidate; a null id is never a query and comes last
among ties; scores beyond a long are cut to its range; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import written

PAGE = 4096
BLOCK = 1024
CELLS = 16
NO_ID = 2**63 - 1
PACKED = "dim int, uids binary, ids binary, codes binary, low binary, width binary, exact binary"


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component as a double; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * 256)))


def pack(size: int, with_cells: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}

        def page(rows: list) -> pd.DataFrame:
            exact = np.array([r[2] for r in rows], dtype=np.int64).reshape(len(rows), -1)
            codes, low, width = np.zeros(0, np.uint8), np.zeros(0), np.zeros(0)
            if with_cells and exact.shape[1]:
                low = exact.min(0).astype(np.float64)
                width = np.maximum(1.0, np.ceil((exact.max(0) - low + 1) / CELLS))
                codes = ((exact - low) // width).astype(np.uint8)
            return pd.DataFrame([(exact.shape[1], np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), codes.tobytes(), low.tobytes(), width.tobytes(), exact.tobytes())], columns=["dim", "uids", "ids", "codes", "low", "width", "exact"])

        for part in parts:
            for row in zip(part["uid"], part["id"], part["ints"], strict=True):
                rows = waiting.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == size:
                    yield page(waiting.pop(len(row[2])))
        for rows in waiting.values():
            yield page(rows)

    return run


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not q.size or float(np.abs(q).max()) * float(np.abs(v).max(initial=0)) * q.size < 2.0**62:
        return v @ q
    wide = v.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in wide], dtype=np.int64)


def page_top(q: np.ndarray, own: int, upper: np.ndarray, lower: np.ndarray, exact: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best vectors of a page, ties to the smaller id."""
    mine = np.flatnonzero(uids == own)
    if mine.size:
        upper[mine] = lower[mine] = -np.inf
    left = np.flatnonzero(upper >= (np.partition(lower, -k)[-k] if lower.size > k else -np.inf))
    left = left[np.argsort(-upper[left], kind="stable")]
    left = left[upper[left] > -np.inf]
    seen, scores, step = 0, np.zeros(0, np.int64), 4 * k
    while seen < left.size and (scores.size < k or upper[left[seen]] >= np.partition(scores, -k)[-k]):
        scores = np.concatenate([scores, exact_scores(q, exact[left[seen : seen + step]])])
        seen += step
    found = left[: scores.size]
    best = np.lexsort((ids[found], -scores))[:k]
    return found[best], scores[best]


def search(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                dim = int(r.dim)
                q = np.frombuffer(r.q_exact, np.int64).reshape(-1, dim) if dim else np.zeros((len(r.q_uids) // 8, 0), np.int64)
                v = np.frombuffer(r.exact, np.int64).reshape(-1, dim) if dim else np.zeros((len(r.uids) // 8, 0), np.int64)
                uids, ids = np.frombuffer(r.uids, np.int64), np.frombuffer(r.ids, np.int64)
                if dim:
                    low = np.frombuffer(r.low) + np.frombuffer(r.codes, np.uint8).reshape(-1, dim) * np.frombuffer(r.width)
                    high = low + np.frombuffer(r.width) - 1
                    plus, minus = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
                    upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
                    slack = 1e-12 * (np.abs(plus).sum() + np.abs(minus).sum()) * (np.abs(low).max() + np.abs(high).max()) if np.abs(upper).max() > 2.0**52 else 0.0
                    upper, lower = upper + slack, lower - slack
                else:
                    upper, lower = np.zeros((len(q), len(v))), np.zeros((len(q), len(v)))
                out = []
                for i, (own, name) in enumerate(zip(np.frombuffer(r.q_uids, np.int64), np.frombuffer(r.q_ids, np.int64), strict=True)):
                    at, scores = page_top(q[i], own, upper[i], lower[i], v, uids, ids, k)
                    out.append(pd.DataFrame({"query_uid": own, "query_id": name, "vec_id": ids[at], "score": scores}))
                yield pd.concat(out) if out else pd.DataFrame({"query_uid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each of its rows that is_query holds for."""
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), integers(F.col(f"`{vector_col}`")).alias("ints")).where("ints is not null")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "va-rows")
    asked = rows.where("query")
    n_blocks = max(1, -(-asked.count() // BLOCK))
    blocks = written(asked.select("uid", "id", "ints").repartition(n_blocks).mapInPandas(pack(BLOCK, False), PACKED).withColumn("mark", F.monotonically_increasing_id()), "va-blocks")
    numbers = written(blocks.select("mark", "dim", (F.row_number().over(Window.orderBy("mark")) - 1).alias("block")), "va-numbers")
    asked_for = blocks.join(numbers.drop("dim"), "mark").select("block", F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    pages = rows.select("uid", "id", "ints").mapInPandas(pack(PAGE, True), PACKED)
    # Every page meets every block of queries with vectors as long as its own, one row for each such pair.
    met = pages.join(numbers.select("dim", "block"), "dim").join(asked_for, "block")
    found = met.select("dim", "uids", "ids", "codes", "low", "width", "exact", "q_uids", "q_ids", "q_exact").mapInPandas(search(k), "query_uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
