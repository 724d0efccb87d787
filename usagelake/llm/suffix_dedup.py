"""Removal of byte strings that occur more than once, by a suffix sort that compares by hashes.

Removed is each byte covered by a LENGTH-byte string that also starts anywhere else. To find such strings
without moving all positions, every window of LENGTH bytes is known by its anchor, the leftmost least of its
GRAM-byte strings in a hash order; neighbouring windows with the same anchor form a run. Equal windows have equal
anchors at equal offsets, so only runs whose anchor string occurs again can hold repeated windows.

1. Anchor hashes are counted over all documents; runs with an anchor that occurs once are done.
2. Equal runs form classes by hashes of their whole strings; classes of two or more are repeated whole.
3. Where an anchor has several classes, one run of each brings the bytes on both sides of the anchor. The
   right sides are sorted by mergesort, a comparison being a binary search over prefix polynomial hashes for
   the common extension, then one byte. Extensions between sorted neighbours give those of all pairs by
   running minima, and the left sides are extended by the same search; the bytes found equal are compared.
   What two runs share on both sides, if LENGTH bytes in all, is a range of repeated windows in both.
4. An anchor with more than GROUP classes isn't brought together in a task: the windows of its classes are
   counted by hash instead, one row for each.
5. Ranges go back to their documents, which cut them out.

Equal texts are one text with a multiplicity, found by hash before; with two or more all bytes go.

Defined cases: null counts as empty; texts under LENGTH bytes stay whole; strings may overlap themselves,
as in long repetitions; ids may be null or repeat, each row counts as a document; very long texts are read in
pieces of PIECE bytes that overlap; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import written

LENGTH = 400
GRAM = 272
WIDTH = LENGTH - GRAM + 1
PIECE = 1 << 19
GROUP = 64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of all substrings of a byte array, for one base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        n = len(data) + 1
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = max(n, 1 << 16)
            step = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
            self._powers[base] = step(base), step(pow(base, -1, 2**64))
        power, self.inverse = self._powers[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def all_of(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by block-wise running minima from both sides."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    front = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def runs_of(pieces: list[bytes], anchors_only: bool) -> tuple[np.ndarray, ...]:
    """Runs of windows in pieces: anchor hash; and run hash, piece, first window, farthest and nearest
    distance from a window's start to the anchor."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = mixed(PrefixHashes(data, BASES[0]).all_of(GRAM))
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    at = (sliding_least((grams & ~low) | place, WIDTH) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= ends[owner]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.concatenate([edge[1:] - 1, [len(at) - 1]])
    first, last = edge[inside[edge]], last[inside[edge]]
    anchor = grams[at[first]].view(np.int64)
    if anchors_only:
        return (anchor,)
    whole = mixed(PrefixHashes(data, BASES[1]).of(first, last - first + LENGTH) + (last - first).astype(np.uint64)).view(np.int64)
    piece = owner[first]
    return anchor, whole, piece, first - (ends - sizes)[piece], at[first] - first, at[first] - last


def runs(docs: DataFrame, anchors_only: bool = False) -> DataFrame:
    """Runs of the texts of docs (th, text); of equal texts a task reads one."""
    schema = "anchor long" if anchors_only else "anchor long, run long, th long, first long, far int, near int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pieces, of, offset, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            found = runs_of(pieces, anchors_only)
            if anchors_only:
                return pa.RecordBatch.from_arrays([pa.array(found[0])], names=["anchor"])
            anchor, whole, piece, first, far, near = found
            th = np.array(of, np.int64)[piece]
            first = first + np.array(offset, np.int64)[piece]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, whole, th, first, far.astype(np.int32), near.astype(np.int32))], names=["anchor", "run", "th", "first", "far", "near"])

        for batch in batches:
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text"), strict=True):
                if th in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(th)
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                for start in range(0, max(0, len(body) - LENGTH + 1), PIECE):
                    pieces.append(body[start : start + PIECE + LENGTH - 1])
                    of.append(th)
                    offset.append(start)
                    size += len(pieces[-1])
                    if size >= PIECE:
                        yield emit()
                        pieces, of, offset, size = [], [], [], 0
        if pieces:
            yield emit()

    return docs.select("th", "text").mapInArrow(run, schema)


def common(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the substrings at a and b have in common, at most `most`: binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    for _ in range(int(high.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_order(data: np.ndarray, hashes: PrefixHashes, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Stable order of substrings within their groups, which lie next to each other: all merges of a level of
    mergesort at once, each element finding its rank in the other half by binary search."""
    order = np.arange(len(start))
    begins = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if len(group) else np.zeros(0, np.int64)
    base = np.repeat(begins, np.diff(np.concatenate([begins, [len(start)]])))
    length = np.repeat(np.diff(np.concatenate([begins, [len(start)]])), np.diff(np.concatenate([begins, [len(start)]])))
    width, most = 1, int(length.max(initial=0))
    while width < most:
        local = np.arange(len(start)) - base
        block = local // (2 * width) * (2 * width)
        in_left = local - block < width
        low = base + block + np.where(in_left, width, 0)
        low = np.minimum(low, base + length)
        first, high = low.copy(), np.minimum(base + block + np.where(in_left, 2 * width, width), base + length)
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not open_.size:
                break
            middle = (low[open_] + high[open_]) >> 1
            x, y = order[open_], order[middle]
            shorter = np.minimum(size[x], size[y])
            same = common(hashes, start[x], start[y], shorter)
            ended = same == shorter
            at = np.where(ended, 0, same)
            less = np.where(ended, size[y] < size[x], data[np.minimum(start[y] + at, len(data) - 1)] < data[np.minimum(start[x] + at, len(data) - 1)])
            tie = ended & (size[x] == size[y])
            before = less | (tie & ~in_left[open_])  # the other half's element comes first
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        rank = base + block + (local - block - np.where(in_left, 0, width)) + (low - first)
        moved = np.empty_like(order)
        moved[rank] = order
        order, width = moved, 2 * width
    return order


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, claimed: np.ndarray) -> np.ndarray:
    """claimed where the bytes agree, else how many do: the hashes' word isn't taken for it."""
    out = claimed.copy()
    for at in range(0, len(a), 20_000):
        most = int(claimed[at : at + 20_000].max(initial=0))
        if most:
            k = np.arange(most)
            x, y = (data[np.minimum(s[at : at + 20_000, None] + k, len(data) - 1)] for s in (a, b))
            out[at : at + 20_000] = np.minimum(claimed[at : at + 20_000], np.cumprod(x == y, 1, dtype=np.uint8).sum(1, dtype=np.int64))
    return out


def shared_windows(anchor: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each run of groups of equal anchors, which distances to the anchor (0 to WIDTH - 1) start a window
    that another run of the group has. left: bytes before the anchor, reversed; right: bytes after it."""
    n = len(anchor)
    data = np.frombuffer(b"".join(right) + b"".join(left) + b"\0", np.uint8)
    sizes = np.array([len(x) for x in right] + [len(x) for x in left], np.int64)
    starts = np.cumsum(sizes) - sizes
    r_start, r_size, l_start, l_size = starts[:n], sizes[:n], starts[n:], sizes[n:]
    hashes = PrefixHashes(data, BASES[1])
    order = suffix_order(data, hashes, r_start, r_size, anchor)
    neighbour = common(hashes, r_start[order[:-1]], r_start[order[1:]], np.minimum(r_size[order[:-1]], r_size[order[1:]]))
    change = np.zeros((n, WIDTH + 1), np.int32)
    reach = np.full(n, WIDTH, np.int64)  # common right extension of order[j] and order[j + shift]
    live, shift = np.arange(n), 1
    while True:
        live = live[live + shift < n]
        live = live[anchor[order[live]] == anchor[order[live + shift]]]
        if not live.size:
            break
        reach[live] = np.minimum(reach[live], neighbour[live + shift - 1])
        x, y = order[live], order[live + shift]
        most = np.minimum(l_size[x], l_size[y])
        able = np.flatnonzero(most + reach[live] >= WIDTH - 1)
        x, y, r, most = x[able], y[able], reach[live][able], most[able]
        lefts = common(hashes, l_start[x], l_start[y], most)
        able = lefts + r >= WIDTH - 1
        x, y, r, lefts = x[able], y[able], r[able], lefts[able]
        r, lefts = equal_bytes(data, r_start[x], r_start[y], r), equal_bytes(data, l_start[x], l_start[y], lefts)
        able = lefts + r >= WIDTH - 1
        for one in (x[able], y[able]):
            np.add.at(change, (one, WIDTH - 1 - np.minimum(r[able], WIDTH - 1)), 1)
            np.add.at(change, (one, lefts[able] + 1), -1)
        shift += 1
    return np.cumsum(change, 1)[:, :WIDTH] > 0


def ranges(covered: np.ndarray) -> list[int]:
    """[near, far, near, far, ...] of the covered distances of a run."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    at[1::2] -= 1
    return at.tolist()


def small_groups(sides: DataFrame) -> DataFrame:
    """anchor, run, ranges of the classes of anchors that have at most GROUP classes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for part in parts:
            held = pd.concat([held, part], ignore_index=True) if len(held) else part
            if len(held) < 20_000:
                continue
            cut = int(np.searchsorted(held["anchor"].to_numpy(), held["anchor"].iloc[-1]))  # the last group may go on
            if cut:
                yield solved(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if len(held):
            yield solved(held)

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        covered = shared_windows(part["anchor"].to_numpy(), list(part["left"]), list(part["right"]))
        some = np.flatnonzero(covered.any(1))
        return pd.DataFrame({"anchor": part["anchor"].to_numpy()[some], "run": part["run"].to_numpy()[some], "ranges": [ranges(covered[i]) for i in some]})

    return sides.select("anchor", "run", "left", "right").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "anchor long, run long, ranges array<int>")


WINDOW = np.dtype([("anchor", "<i8"), ("run", "<i8"), ("window", "<i8"), ("distance", "<i2")])


def exchanged(packed: DataFrame, solve, schema: str) -> DataFrame:
    """Runs solve on the records of each bucket; packed has rows of a bucket number and many records as bytes,
    so records move in columns and not as rows of their own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, records = None, []
        for part in parts:
            for bucket, data in zip(part["bucket"], part["records"], strict=True):
                if bucket != held and records:
                    yield solve(np.frombuffer(b"".join(records), WINDOW))
                    records = []
                held = bucket
                records.append(data)
        if records:
            yield solve(np.frombuffer(b"".join(records), WINDOW))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def in_buckets(records: np.ndarray, key: np.ndarray, buckets: int) -> pd.DataFrame:
    bucket = (mixed(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    return pd.DataFrame({"bucket": names, "records": [x.tobytes() for x in np.split(records[order], first[1:])] if len(names) else []})


def large_groups(sides: DataFrame) -> DataFrame:
    """The same for other anchors, by counting each window's hash: buckets of windows, then of classes."""
    buckets = max(64, sides.count() // 500)

    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 2000):
                few = part.iloc[at : at + 2000]
                left, right = [x[::-1] for x in few["left"]], list(few["right"])
                data = np.frombuffer(b"".join(x + y for x, y in zip(left, right, strict=True)), np.uint8)
                l_size, r_size = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
                anchor_at = np.cumsum(l_size + r_size) - r_size
                near = np.maximum(0, WIDTH - 1 - r_size)
                count = l_size - near + 1
                row = np.repeat(np.arange(len(few)), count)
                found = np.zeros(len(row), WINDOW)
                found["distance"] = distance = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[row]
                one, two = (PrefixHashes(data, b).of(anchor_at[row] - distance, WIDTH - 1) for b in BASES)
                found["anchor"], found["run"] = few["anchor"].to_numpy()[row], few["run"].to_numpy()[row]
                found["window"] = mixed(mixed(one) ^ (two * np.uint64(BASES[0]))).view(np.int64)
                yield in_buckets(found, found["window"] + found["anchor"], buckets)

    def repeated(found: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((found["distance"], found["anchor"], found["window"]))
        found = found[order]
        same = (found[1:]["window"] == found[:-1]["window"]) & (found[1:]["anchor"] == found[:-1]["anchor"]) & (found[1:]["distance"] == found[:-1]["distance"])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return in_buckets(found[again], found["run"][again] + found["anchor"][again], buckets)

    def gathered(found: np.ndarray) -> pd.DataFrame:
        found = found[np.lexsort((found["distance"], found["run"], found["anchor"]))]
        edge = np.flatnonzero(np.concatenate([[True], (found[1:]["run"] != found[:-1]["run"]) | (found[1:]["anchor"] != found[:-1]["anchor"])])) if len(found) else np.zeros(0, np.int64)
        covered = []
        for part in np.split(found["distance"], edge[1:]) if len(edge) else []:
            held = np.zeros(WIDTH, bool)
            held[part] = True
            covered.append(ranges(held))
        return pd.DataFrame({"anchor": found["anchor"][edge], "run": found["run"][edge], "ranges": covered})

    packed = "bucket long, records binary"
    first = sides.select("anchor", "run", "left", "right").mapInPandas(windows, packed)
    return exchanged(exchanged(first, repeated, packed), gathered, "anchor long, run long, ranges array<int>")


def brought(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """anchor, run, left (reversed), right of one run of each class."""
    wanted = classes.select("anchor", "run", F.col("one.th").alias("th"), F.col("one.first").alias("first"), F.col("one.far").alias("far"), F.col("one.near").alias("near"), "n_classes")
    by_text = wanted.groupBy("th").agg(F.collect_list(F.struct("anchor", "run", "first", "far", "near", "n_classes")).alias("wanted"))
    owners = docs.groupBy("th").agg(F.min(F.struct("doc_id", "at")).alias("o"))
    by_row = by_text.join(owners, "th").select("th", F.col("o.doc_id").alias("_id"), F.col("o.at").alias("_at"), "wanted")
    rows = docs.join(by_row.withColumnRenamed("th", "_th"), (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                body = text.as_buffer().to_pybytes()
                for w in wanted:
                    anchor = w["first"] + w["far"]
                    last = anchor - w["near"]
                    for k, v in enumerate((w["anchor"], w["run"], body[w["first"] : anchor][::-1], body[anchor + GRAM : last + LENGTH], w["n_classes"])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())], names=["anchor", "run", "left", "right", "n_classes"])

    return rows.mapInArrow(run, "anchor long, run long, left binary, right binary, n_classes long").dropDuplicates(["anchor", "run"])


def cut(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of text, bytes removed, and maximal removed runs; spans: (anchor's place, ranges)."""
    change = sorted({(s["anchor_at"] - far, s["anchor_at"] - near + LENGTH) for s in spans for near, far in zip(s["ranges"][::2], s["ranges"][1::2], strict=True)})
    kept, at, removed, n = [], 0, 0, 0
    reach = -1
    for start, stop in change:
        if start > reach:
            kept.append(text[at:start])
            n += 1
            at = start
        if stop > at:
            removed += stop - max(at, start)
            at = stop
        reach = max(reach, stop)
    kept.append(text[at:])
    return b"".join(kept), removed, n


def repeated_spans(docs: DataFrame) -> DataFrame:
    """th, spans (anchor_at, ranges) of texts with repeated windows; docs has doc_id, text, th and at."""
    counts = runs(docs, anchors_only=True).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = written(runs(docs).join(written(counts, "anchors"), "anchor"), "runs")
    classes = again.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("th", "first", "far", "near")).alias("one"))
    classes = written(classes, "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
    sides = written(brought(docs, classes.join(several, "anchor")), "sides")
    covers = small_groups(sides.where(F.col("n_classes") <= GROUP)).unionByName(large_groups(sides.where(F.col("n_classes") > GROUP)))
    whole = classes.where("n > 1").select("anchor", "run", F.array(F.col("one.near"), F.col("one.far")).alias("ranges"))
    covers = written(covers.join(whole.select("anchor", "run"), ["anchor", "run"], "left_anti").unionByName(whole), "covers")
    spans = again.join(covers, ["anchor", "run"]).select("th", (F.col("first") + F.col("far")).alias("anchor_at"), "ranges").distinct()
    return written(spans.groupBy("th").agg(F.collect_list(F.struct("anchor_at", "ranges")).alias("spans")), "spans")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for each row of docs."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select("doc_id", body.alias("text")).withColumn("th", text_hash(F.col("text"))).withColumn("at", F.crc32("text"))
    copies = docs.groupBy("th").agg(F.count("*").alias("n")).where("n > 1").withColumn("copied", F.lit(True)).select("th", "copied")
    found = copies.join(repeated_spans(docs), "th", "full").select("th", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied").isNull(), F.col("spans")).alias("spans"))
    rows = docs.join(found, "th", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for text, copied, spans in zip(part.column("text").to_pylist(), part.column("copied").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    kept, removed, n = (b"", len(text), 1) if copied and len(text) >= LENGTH else cut(text, spans) if spans else (text, 0, 0)
                    for k, v in enumerate((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)
