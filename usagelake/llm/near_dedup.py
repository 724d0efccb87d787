"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, as 64-bit hashes. Equal sets become one class first. Each of
several independent trees sends a class down a path of minwise tokens: a node of a tree holds the classes
that agree on the path so far, one of a single class is dropped, one of at most NODE classes is a leaf, a
larger one branches by the next token, down to DEPTH. Leaves are compared exhaustively by sketches; classes
of a larger node at full depth hang together. What hangs together over all trees forms families, a superset
of the linked groups. In each family the full sets are compared, and only pairs whose exact similarity
reaches the threshold are links; components of links are the result.

Trees: as many as make the chance that a pair right at the threshold meets in none of them, if every node
branched to full depth, less than 1 - recall.

No step holds an unbounded group: a family beyond FAMILY classes (or FAMILY_CHARS characters) is cut into
chunks that share a few pivots; then the classes outside its greatest component meet every chunk.

Defined cases: documents without words (null or blank texts too) have empty sets, are linked with nothing
and are kept; with fewer words than a shingle the whole sequence is the one shingle; a null id is never
a component's least id while it has another; rows that repeat an id count as one document and are kept
alike; an empty table gives an empty table; other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from usagelake.llm.common import prefiltered, written
from usagelake.llm.graph import connected_components

DEPTH = 4
NODE = 48
FAMILY = 512
FAMILY_CHARS = 16_000_000
PIVOTS = 8
CACHE = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words; a word's hash depends on the word alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (A-Z lower-cased, words parted by ASCII white space)."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ (s >> np.uint64(31))) * MULTIPLIER + h[k : len(h) - n + 1 + k]
    s = (s ^ (s >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(s ^ (s >> np.uint64(29)))


def minwise(s: np.ndarray, salts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """For each function the least image of the set, its high 32 bits."""
    out = np.full(len(odds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, ((s[None, at : at + 4096] ^ salts[:, None]) * odds[:, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def functions_of(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, count, dtype=np.uint64), rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees_for(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH)))


def sketches(docs: DataFrame, size: int, trees: int) -> DataFrame:
    salts, odds = functions_of(trees * DEPTH)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    schema = docs.select("doc_id", "tk").schema.add("n_shingles", "long").add("h1", "long").add("h2", "long").add("n_chars", "long").add("mins", ArrayType(IntegerType())).add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 2048):
                part = batch.slice(at, 2048)
                n, chars, digest = [], [], []
                mins = np.zeros((part.num_rows, trees * DEPTH), np.uint32)
                for i, text in enumerate(part.column("text").to_pylist()):
                    s = shingles(text, size, words)
                    n.append(len(s))
                    chars.append(len(text or ""))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(s):
                        mins[i] = minwise(s, salts, odds)
                h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mins.size + 1, trees * DEPTH, dtype=np.int32)), pa.array(mins.view(np.int32).ravel()))
                sketch = pa.array([bytes(r) for r in mins.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(chars, pa.int64()), lists, sketch], names=schema.names)

    return docs.mapInArrow(run, schema)


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def likely(sketch: np.ndarray, n: np.ndarray, other: np.ndarray, n_other: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose sketches are within five deviations of it."""
    t = num / den
    least = max(1.0, (t - 5 * math.sqrt(t * (1 - t) / sketch.shape[1])) * sketch.shape[1])
    small, large = np.minimum(n[:, None], n_other[None]), np.maximum(n[:, None], n_other[None])
    ok = den * small >= num * large
    agree = np.zeros(ok.shape, np.int16)
    for k in range(sketch.shape[1]):
        agree += sketch[:, k][:, None] == other[:, k][None]
    return ok & (agree >= least)


def leaf_edges(num: int, den: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = [], []
            for row in part["members"]:
                vids = [r["vid"] for r in row]
                sketch = np.frombuffer(b"".join(r["sketch"] for r in row), np.uint8).reshape(len(row), -1)
                n = np.array([r["n_shingles"] for r in row])
                groups = Groups(len(row))
                for i, j in zip(*np.nonzero(np.triu(likely(sketch, n, sketch, n, num, den), 1)), strict=True):
                    if groups.join(i, j):
                        a.append(vids[i])
                        b.append(vids[j])
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def families(classes: DataFrame, trees: int, num: int, den: int) -> DataFrame:
    """vid, family: classes that hang together by leaves and full-depth nodes of the trees."""
    first = F.array(*[F.element_at("mins", t * DEPTH + 1) for t in range(trees)])
    rows = classes.select("vid", F.posexplode(first).alias("tree", "token")).select("vid", "tree", F.xxhash64(F.col("tree").cast("long"), "token").alias("node"))
    leaves, deep = None, None
    for depth in range(1, DEPTH + 1):
        # Most nodes hold one class and end here, so the classes' sketches and paths join those that are left.
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = written(rows.join(sizes, "node"), "path-nodes")
        leaf = rows.where(F.col("size") <= NODE).select("node", "vid")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        rows = rows.where(F.col("size") > NODE).drop("size")
        if rows.isEmpty():
            break
        deep = rows if depth == DEPTH else None
        if depth < DEPTH:
            token = F.element_at("mins", F.col("tree") * DEPTH + depth + 1)
            rows = rows.join(classes.select("vid", "mins"), "vid").select("vid", "tree", F.xxhash64("node", token).alias("node"))
    members = leaves.join(classes.select("vid", "n_shingles", "sketch"), "vid").groupBy("node").agg(F.collect_list(F.struct("vid", "n_shingles", "sketch")).alias("members"))
    edges = members.select("members").mapInPandas(leaf_edges(num, den), "a long, b long")
    if deep is not None:
        deep = deep.select("node", "vid")
        edges = edges.unionByName(deep.join(deep.groupBy("node").agg(F.min("vid").alias("a")), "node").where("a <> vid").select("a", F.col("vid").alias("b")))
    return connected_components(edges, "a", "b").select(F.col("node").alias("vid"), F.col("component").alias("family"))


def verify(size: int, num: int, den: int, keys: list[str]):
    """Links of groups of rows that share keys, a spanning set of them: rows of role 1 with all others of role
    0, where some row has role 1, else all rows with one another. Groups arrive sorted and in one piece."""

    def links(rows: list) -> tuple[list[int], list[int]]:
        vids = [r[0] for r in rows]
        words, sets = Words(), {}
        n = np.array([r[1] for r in rows])
        sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        role = np.array([r[4] for r in rows])
        comps = np.array([r[5] for r in rows])
        if role.any():
            left, right = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
            pairs = likely(sketch[left], n[left], sketch[right], n[right], num, den)
            i, j = np.nonzero(pairs)
            i, j = left[i], right[j]
        else:
            i, j = np.nonzero(np.triu(likely(sketch, n, sketch, n, num, den), 1))
        groups, first = Groups(len(rows)), {}
        for k, c in enumerate(comps):  # classes known to be connected already
            if c >= 0:
                groups.join(first.setdefault(c, k), k)

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(rows[k][3], size, words)
            return sets[k]

        a, b = [], []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if groups.find(x) != groups.find(y):
                s, t = full(x), full(y)
                if len(s) > len(t):
                    s, t = t, s
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
                if den * common >= num * (len(s) + len(t) - common) and common:
                    groups.join(x, y)
                    a.append(vids[x])
                    b.append(vids[y])
        return a, b

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, []
        for part in parts:
            a, b = [], []
            for key, row in zip(zip(*[part[k] for k in keys], strict=True), zip(part["vid"], part["n_shingles"], part["sketch"], part["text"], part["role"], part["comp"], strict=True), strict=True):
                if key != held and rows:
                    x, y = links(rows)
                    a, b, rows = a + x, b + y, []
                held = key
                rows.append(row)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")
        if rows:
            x, y = links(rows)
            yield pd.DataFrame({"a": x, "b": y}, dtype="int64")

    return run


def verified(rows: DataFrame, keys: list[str], size: int, num: int, den: int) -> DataFrame:
    rows = rows.select(*keys, "vid", "n_shingles", "sketch", "text", "role", "comp")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "vid").mapInPandas(verify(size, num, den, keys), "a long, b long")


def exact_links(docs: DataFrame, classes: DataFrame, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """a, b: verified links that connect exactly what all links connect within families."""
    totals = members.join(classes.select("vid", "n_chars"), "vid").groupBy("family").agg(F.count("*").alias("members"), F.sum("n_chars").alias("chars"))
    totals = written(totals.withColumn("chunks", F.ceil(F.greatest(F.col("members") / FAMILY, F.col("chars") / FAMILY_CHARS)).cast("int")), "families")
    ids = members.join(totals, "family").join(classes.select("vid", "doc_id", "tk", "n_shingles", "sketch", "h1", "h2"), "vid")
    # A class is read back through one of its rows, by id and hash of the text; the set is compared again.
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tk"), "text")
    texts = prefiltered(keyed, F.col("_tk"), ids, F.col("tk"))
    rows = ids.join(texts, (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_tk")
    rows = rows.select("family", "chunks", "vid", "n_shingles", "sketch", "h1", "h2", "text", F.pmod(F.xxhash64("vid"), F.col("chunks").cast("long")).alias("chunk"), F.lit(0).alias("role"), F.lit(-1).cast("long").alias("comp"))
    rows = same_set(rows, size)
    large = totals.where("chunks > 1")
    links = written(verified(rows.where("chunks = 1"), ["family"], size, num, den), "links")
    if large.isEmpty():
        return links
    rows = written(rows.where("chunks > 1"), "large-families")
    # A few pivots of each large family join all of its chunks.
    best = rows.groupBy("family").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("vid", F.lit(1)), F.col("chunks") * F.lit(FAMILY // 8)) < PIVOTS, F.struct(F.xxhash64("vid").alias("h"), F.col("vid").alias("p"))))), 1, PIVOTS).alias("best"))
    pivots = rows.join(best.select("family", F.explode("best.p").alias("vid")), ["family", "vid"]).withColumnRenamed("chunk", "home").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))).where("chunk <> home").drop("home")
    links = links.unionByName(written(verified(rows.unionByName(pivots), ["family", "chunk"], size, num, den), "links"))
    known = connected_components(links, "a", "b").select(F.col("node").alias("vid"), F.col("component").alias("found"))
    state = rows.join(known, "vid", "left").withColumn("comp", F.coalesce("found", "vid")).drop("found")
    counts = state.groupBy("family", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    main = main.withColumn("rest_chunks", F.ceil((F.col("all") - F.col("top.n")) / FAMILY).cast("long")).select("family", F.col("top.comp").alias("main"), "rest_chunks").where("rest_chunks > 0")
    if main.isEmpty():
        return links
    state = state.join(main, "family")
    rest = state.where("comp <> main").withColumn("rest_chunk", F.pmod(F.xxhash64("vid", F.lit(2)), F.col("rest_chunks")))
    rest = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))).withColumn("role", F.lit(1))
    against = state.withColumn("rest_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_chunks") - 1)))
    more = verified(against.unionByName(rest), ["family", "chunk", "rest_chunk"], size, num, den)
    return links.unionByName(written(more, "links"))


def same_set(rows: DataFrame, size: int) -> DataFrame:
    """One row of each class, whose text has the set it stands for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for part in parts:
            digests = [np.frombuffer(xxhash.xxh3_128_digest(shingles(t, size, words).tobytes()), np.int64) for t in part["text"]]
            fits = np.array([d[0] == a and d[1] == b for d, a, b in zip(digests, part["h1"], part["h2"], strict=True)], bool)
            yield part[fits].drop_duplicates("vid")

    return rows.mapInPandas(run, rows.schema).drop("h1", "h2").dropDuplicates(["vid"])


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, recall: float = 0.9999) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs.

    Linked are documents with den * common >= num * (shingles of either), in sets of size-word shingles.
    """
    trees = trees_for(num / den, recall)
    docs = docs.select("doc_id", "text")
    every = written(sketches(docs, size, trees), "sketches")
    sets = every.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("o"), F.first("n_shingles").alias("n_shingles"), F.max("n_chars").alias("n_chars"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"))
    sets = sets.withColumns({"doc_id": F.col("o.doc_id"), "tk": F.col("o.tk")}).drop("o")
    classes = written(sets.withColumn("vid", F.monotonically_increasing_id()), "classes")
    members = written(families(classes, trees, num, den), "members")
    links = exact_links(docs, classes, members, size, num, den)
    found = connected_components(links, "a", "b").select(F.col("node").alias("vid"), "component")
    of_class = classes.select("vid", "h1", "h2", "doc_id").join(found, "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(least, "component").select("h1", "h2", "component_id")
    rows = every.where("n_shingles > 0").join(of_class, ["h1", "h2"], "left").select("doc_id", "n_shingles", "component_id")
    rows = rows.unionByName(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one document of each component: that with the least id."""
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
