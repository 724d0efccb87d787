"""Blocks of op4: what is found doesn't depend on their size, and candidates grow with their rows."""

import os

import pytest
from pyspark.sql import functions as F

from usagelake.llm import line_dedup


def links_of(spark, lines, keys):
    """Pairs linked among lines whose blocks are given, and the numbers of candidates."""
    table = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    blocks = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "class long, first array<bigint>")
    one = F.struct("doc_id", F.xxhash64("text").alias("key"), F.lit(0).alias("number")).alias("one")
    classes = table.select(F.col("doc_id").alias("class"), one).join(blocks, "class").select("class", "one", F.struct(F.lit(10).alias("n"), "first").alias("keys"))
    return {frozenset((r.a, r.b)) for r in line_dedup.edit_links(table, classes, 0.8).collect()}


@pytest.mark.parametrize("shared", [4, 1024])
def test_pairs_that_share_only_a_large_block_are_found(spark, shared, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARED", shared)
    lines = [" ".join(["the", "same", "three", *(f"w{i // 2}x{k}" for k in range(6)), f"v{i}"]) for i in range(40)]
    # One block is shared by all, each of the others is a line's own.
    found = links_of(spark, lines, [[1, *(100 + 10 * i + k for k in range(7))] for i in range(40)])
    assert found == {frozenset((i, i + 1)) for i in range(0, 40, 2)}


def test_candidates_of_near_copies_grow_with_their_number(spark, monkeypatch):
    base, written, candidates = [f"w{k}" for k in range(40)], line_dedup.written, []

    def counting(df, name):
        table = written(df, name)
        if name == "line-candidates":
            candidates.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "written", counting)
    lines = [" ".join([*base[: i % 40], f"v{i}", *base[i % 40 + 1 :]]) for i in range(80)]
    found = links_of(spark, lines, [list(range(8))] * 80)
    assert {c for pair in found for c in pair} == set(range(80))
    assert sum(candidates) <= line_dedup.PIVOTS * 80


def test_lines_and_keys_are_gone_when_candidates_are_written(spark, monkeypatch):
    rows = [(i, "\n".join(" ".join([*(f"w{j}x{k}" for k in range(9)), f"v{i % 3}"]) for j in range(i, i + 4))) for i in range(30)]
    written, names, left = line_dedup.written, [], []

    def listing(df, name, *more):
        if name == "line-candidates":
            left.append([n for n, t in names if os.path.exists(t.written_at.removeprefix("file:"))])
        table = written(df, name, *more)
        names.append((name, table))
        return table

    monkeypatch.setattr(line_dedup, "written", listing)
    found = {r.doc_id: r.n_removed for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0} | dict.fromkeys(range(1, 30), 3)
    assert len(left) == 2
    assert not {"lines", "line-classes"} & {n for names in left for n in names}
