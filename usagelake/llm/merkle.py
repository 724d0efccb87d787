"""A Merkle manifest of a table: one root, and for each row the path that proves it.

1. Leaves are hashes of the rows' fields, made with built-in functions; only they travel on, not the texts.
2. A group's leaves are numbered in the order of their key: by ranges of (group, key), each numbered by itself, after the sizes of the
   ranges before it. No task holds a group.
3. A group's nodes are cut into aligned blocks of 2**BLOCK. Each block gives its root, roots are nodes of the next level, until one
   is left; the groups' roots are the leaves of a tree of their own, made in the same way.
4. From the top down, each block's paths are found by Merkle traversal in logarithmic space and time: one treehash stack for each
   height makes the sibling that is needed next, of the 2 * height - 1 steps each leaf pays for the stack with the lowest node goes
   first, so that all of them hold O(height) nodes. The path of the block's root, made before, is put behind each of them.

A run without a second node is hashed alone, so a node's path says for each level on which side its sibling is: L, R, or - for none.

Defined cases: null fields have a hash of their own (see leaf); a null group is a group, the first; null keys come before others;
rows that share a key are ordered by their leaf, so rows repeated in full have one path each; an empty table gives an empty table; fields, key and group are named,
so other columns of the input don't count and can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from usagelake.llm.common import scratch, written

#: Aligned blocks have 2**BLOCK nodes; a block is what one call of Python holds.
BLOCK = 10


def leaf(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields in order: - for null, else the count of its UTF-8 bytes, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(":").cast("binary"), text.cast("binary")))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def joined(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Makes the node of one height over leaves from a start on, a step at a time, holding at most one node of each height."""

    def __init__(self, leaves: Sequence[str], height: int, start: int) -> None:
        self.leaves, self.height, self.next = leaves, height, start
        self.stop = min(start + (1 << height), len(leaves))
        self.stack: list[tuple[int, str]] = []
        self.missing = start >= self.stop

    @property
    def done(self) -> bool:
        return self.missing or (len(self.stack) == 1 and self.stack[0][0] == self.height)

    @property
    def low(self) -> int:
        """The height of the lowest node: the stack where it is least goes first."""
        return 1 << 30 if self.done else self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            height, right = stack.pop()
            stack[-1] = (height + 1, joined(stack[-1][1], right))
        elif self.next < self.stop:
            stack.append((0, self.leaves[self.next]))
            self.next += 1
        else:  # leaves ended early: the last node has no sibling
            stack[-1] = (stack[-1][0] + 1, joined(stack[-1][1]))

    def node(self) -> str | None:
        while not self.done:
            self.step()
        return None if self.missing else self.stack[0][1]


def block_root(leaves: Sequence[str], height: int) -> str:
    return Treehash(leaves, height, 0).node()


def traversal(leaves: Sequence[str], height: int):
    """Yields the siblings of each leaf in turn, from the bottom up, None where there is none."""
    siblings = [Treehash(leaves, h, 1 << h).node() for h in range(height)]
    coming = [Treehash(leaves, h, 0) for h in range(height)]
    for made in coming:
        made.node()
    for at in range(len(leaves)):
        yield siblings
        for h in range(height):
            if (at + 1) % (1 << h):
                break
            siblings[h] = coming[h].node()
            coming[h] = Treehash(leaves, h, (at + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            focus = min(coming, key=lambda made: made.low)
            if focus.done:
                break
            focus.step()


def block_height(n: int, bits: int) -> int:
    """The levels of a block in a group of n nodes."""
    return min(bits, (n - 1).bit_length())


def numbered(df: DataFrame, group: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Adds pos, counted from 0 in each group, and n, the group's size, as a written table of group, keep, pos, n."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_row").withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "merkle-ranges")
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), F.sum("_size").over(of_group).alias("n"))
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_row")
    rows = ranged.withColumn("_place", F.row_number().over(inside)).join(sizes, [group, "_part"])
    return written(rows.select(group, *keep, (F.col("_before") + F.col("_place") - 1).cast("long").alias("pos"), "n"), "merkle-nodes")


def levels(nodes: DataFrame, group: str, bits: int) -> list[DataFrame]:
    """nodes (group, pos, n, node and others) and the roots above them, level by level, until each group has one."""

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        made = block_root(block["node"].to_pylist(), block_height(n, bits))
        return pa.table({group: block[group].slice(0, 1), "pos": block["block"].slice(0, 1), "n": pa.array([-(-n >> bits)], pa.int64()), "node": [made]})

    found = [nodes]
    most = nodes.agg(F.max("n")).first()[0]
    while most is not None:
        below = found[-1].select(group, "pos", "n", "node", F.shiftright("pos", bits).alias("block"))
        found.append(written(below.groupBy(group, "block").applyInArrow(root, f"{group} string, pos long, n long, node string"), "merkle-roots"))
        most = -(-most >> bits)
        if most == 1:
            break
    return found


def with_paths(names: Sequence[str], carry: Sequence[str], bits: int, schema: pa.Schema):
    """For a block and the row of its root: the block's rows by their columns names, with whole paths and the root's columns carry."""

    def paths(block: pa.Table, upper: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        block = block.sort_by("pos")
        high_sides, high = upper["sides"][0].as_py(), upper["siblings"][0].as_py()
        sides, siblings = [], []
        for at, path in enumerate(traversal(block["node"].to_pylist(), block_height(block["n"][0].as_py(), bits))):
            sides.append("".join("-" if x is None else "L" if at >> h & 1 else "R" for h, x in enumerate(path)) + high_sides)
            siblings.append([x or "" for x in path] + high)
        shared = [pa.array([upper[c][0].as_py()] * block.num_rows, pa.string()) for c in carry]
        return pa.Table.from_arrays([*(block[c] for c in names), pa.array(sides, pa.string()), pa.array(siblings, pa.list_(pa.string())), *shared], schema=schema)

    return paths


def descended(found: list[DataFrame], group: str, bits: int, top: DataFrame, carry: Sequence[str], keep: Sequence[str]) -> Iterator[DataFrame]:
    """The paths of each level, the lowest last: its rows with keep, sides, siblings and the columns carry of top, which has
    a row (group, pos = 0, sides, siblings) for each group's root. Each but the last is written."""
    for depth in reversed(range(len(found) - 1)):
        nodes, names = found[depth], [group, "pos", *(keep if depth == 0 else [])]
        schema = StructType([nodes.schema[c] for c in names]).add("sides", StringType()).add("siblings", ArrayType(StringType()))
        for c in carry:
            schema = schema.add(c, StringType())
        blocks = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy(group, "block")
        roots = top.withColumnRenamed("pos", "block").groupBy(group, "block")
        top = blocks.cogroup(roots).applyInArrow(with_paths(names, carry, bits, to_arrow_schema(schema)), schema)
        if depth:
            top = written(top, "merkle-paths")
        yield top


def manifest(docs: DataFrame, key: str, group: str, fields: Sequence[str], keep: dict[str, Column] | None = None, bits: int = BLOCK) -> DataFrame:
    """key, the columns keep (made of the row), leaf, position in its group, sides and siblings of its path, subroot and root, one row for each of docs.

    siblings has an entry for each level, empty where the side is -; see folded and proof.
    """
    keep = keep or {}
    rows = docs.select(
        F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")).alias("tree"), F.col(f"`{key}`").alias("key"), leaf([F.col(f"`{f}`") for f in fields]).alias("node"),
        *[c.alias(f"kept_{i}") for i, c in enumerate(keep.values())],
    ).withColumn("tree", F.coalesce("tree", F.lit("")))
    held = ["key", "node", *(f"kept_{i}" for i in range(len(keep)))]
    with scratch() as tables:
        below = levels(tables.keep(numbered(rows, "tree", ["key", "node"], held)), "tree", bits)
        if len(below) == 1:  # no rows
            found = below[0].selectExpr(*held, "pos", "'' sides", "array('') siblings", "node subroot", "node root")
        else:
            subroots = below[-1].select(F.lit("").alias("top"), F.col("tree").alias("name"), "node")
            above = levels(numbered(subroots, "top", ["name"], ["name", "node"]), "top", bits)
            ends = above[-1].select("top", "pos", F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"), F.col("node").alias("root"))
            *_, tops = descended(above, "top", bits, ends, ["root"], ["name", "node"])
            tops = tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "sides", "siblings", F.col("node").alias("subroot"), "root")
            for found in descended(below, "tree", bits, tables.keep(written(tops, "merkle-tops")), ["subroot", "root"], held):
                if hasattr(found, "written_at"):
                    tables.keep(found)
    named = {f"kept_{i}": name for i, name in enumerate(keep)}
    return found.select(F.col("key").alias(key), *[F.col(c).alias(n) for c, n in named.items()], F.col("node").alias("leaf"), F.col("pos").alias("position"), "sides", "siblings", "subroot", "root")


def proof(siblings: Column) -> Column:
    """One hash of all siblings, level by level."""
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def folded(node: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its path lead to; the path proves the leaf if this is the manifest's root."""
    step = F.zip_with(siblings, F.split(sides, ""), lambda other, side: F.struct(other.alias("other"), side.alias("side")))
    up = lambda at, s: F.sha2(F.when(s["side"] == "L", F.concat(s["other"], at)).when(s["side"] == "R", F.concat(at, s["other"])).otherwise(at).cast("binary"), 256)
    return F.aggregate(F.filter(step, lambda s: s["side"] != ""), node, up)
