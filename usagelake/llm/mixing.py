"""Mixing sources to target weights by a low-discrepancy schedule; built-in functions only.

1. Sources in code-point order (null last) take the weights in turn; each source's target is its share of
   budget * all words, stopped at max_repeat times its own words, the excess shared again by weight.
2. Slot n of the schedule, of as many as blocks of block_words words make up all targets, maps the golden-ratio point
   frac((n + 1) * phi), on a grid of 2**31, through the cumulative targets to a source; the slots of a source are ranked
   in the order of n.
3. A source's documents are shuffled by a digest and laid end to end, max_repeat times over; that run is cut into blocks
   of block_words words. The slot of rank k of a source takes its block k (what there is of it, where the run ends),
   so the schedule decides what is taken: a source's words miss its target by as many blocks as its slots
   miss their share, which is a few for points of low discrepancy, however many slots there are.

Sums and ranks inside a source are made in cells (see common.before); no task holds a whole source.

Defined cases: null or blank text has size 0 and takes nothing; a null source is a source of its own and
comes last; a null doc_id is an id like any other; rows repeated in full count each; an empty table
gives empty tables. Other columns of the input pass through where `carry` names them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import WORD, before, hex_cell, written

GRID = 2**31
#: GRID divided by the golden ratio, made odd so that the points of one period differ.
STEP = 1327217885
BIN = 2**21
CHUNK = 2**16


@dataclass
class Mixture:
    sources: DataFrame  #: source_key, source_size, weight, target, words (target in whole words), slots
    schedule: DataFrame  #: slot, source_key, block
    placed: DataFrame  #: documents with source_key, size, at (words of the source before it), source_size, target, words, slots
    pieces: DataFrame  #: the schedule joined with the documents: slot, source_key, at, doc_id, size, turn, first_word, n_words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, max_repeat: int) -> DataFrame:
    """One row for each source; the windows without partition run over that many rows."""
    total = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("source_key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    total = total.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * max_repeat)
    rise = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    everything = Window.partitionBy()
    total = (
        total.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("caps_below", F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_from", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("weights_from") <= F.col("weight") * (F.col("wanted") - F.col("caps_below")))
        .withColumn("caps_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("weights_open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("wanted") - F.col("caps_full")) / F.col("weights_open")))
    )
    share = F.col("cumulative") / F.sum("target").over(everything) * float(GRID)
    total = total.withColumn("words", F.round("target").cast("long")).withColumn("cumulative", F.sum("target").over(order))
    total = total.withColumn("upto", F.when(F.col("wanted") > 0, F.floor(share)).otherwise(0).cast("long"))
    total = total.withColumn("from", F.coalesce(F.lag("upto").over(order), F.lit(0)).cast("long")).withColumn("turn", F.row_number().over(order))
    return total.select("source_key", "source_size", "weight", "target", "words", "from", "upto", "turn")


def slot_sources(sources: DataFrame, n_slots: int) -> DataFrame:
    """slot, source_key, block: golden-ratio points through the cumulative targets, ranked for each source."""
    spark = sources.sparkSession
    points = spark.range(n_slots).select(F.col("id").alias("slot"), ((((F.col("id") + 1) % GRID) * STEP) % GRID).alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") / BIN))
    spans = sources.where("upto > from").select("source_key", "from", "upto", F.explode(F.sequence(F.floor(F.col("from") / BIN), F.floor((F.col("upto") - 1) / BIN))).alias("bin"))
    drawn = points.join(spans, "bin").where("point >= from and point < upto").select("slot", "source_key", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    return before(drawn, ["source_key"], "chunk", ["slot"], F.lit(1).cast("long"), "block").select("slot", "source_key", "block")


def mixture(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_repeat: int = 2, block_words: int = 64, seed: str = "mix", carry: Sequence[str] = ()) -> Mixture:
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~null")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary")).alias("_place"),
        *[F.col(f"`{c}`").alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_cell", hex_cell(F.col("_place")))
    rows = rows if carry else written(rows, "mix-sizes")
    sources = written(source_targets(rows, weights, budget, max_repeat), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    schedule = written(slot_sources(sources, -(-words // block_words)), "mix-schedule")
    slots = schedule.groupBy("source_key").agg(F.count("*").alias("slots"))
    sources = sources.join(slots, "source_key", "left").select("source_key", "source_size", "weight", "target", "words", F.coalesce("slots", F.lit(0)).alias("slots"))
    placed = before(rows, ["source_key"], "_cell", ["_place"], F.col("size"), "at").join(sources, "source_key")
    run = placed.where("size > 0").select("source_key", "doc_id", "size", "at", "source_size", "slots", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("turn"))
    run = run.withColumn("start", F.col("at") + F.col("turn") * F.col("source_size")).withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("slots") * block_words)).where("start < stop")
    run = run.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))))
    run = run.withColumn("cut", F.greatest(F.col("start"), F.col("block") * block_words)).withColumn("n_words", F.least(F.col("stop"), (F.col("block") + 1) * block_words) - F.col("cut"))
    pieces = run.join(schedule, ["source_key", "block"]).select("slot", "source_key", "at", "doc_id", "size", "turn", (F.col("cut") - F.col("start")).alias("first_word"), "n_words")
    return Mixture(sources, schedule, placed, pieces)


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: the digest of the mixture."""
    mix = mixture(docs, **options)
    digest = ["doc_id", "size", "source_size", "target"]
    # Of the rows of a source, only one with words starts at a given word, so (source_key, at) names it.
    taken = mix.pieces.groupBy("source_key", "at").agg(F.sum("n_words").alias("taken"))
    full = mix.placed.where("size > 0").join(taken, ["source_key", "at"], "left").select(*digest, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return full.unionByName(mix.placed.where("size = 0").select(*digest, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, block_words: int = 64, max_repeat: int = 2, **options) -> DataFrame:
    """The documents of the mix with all their columns: one copy for each of a document's turns of which a slot takes
    a piece. Texts stay whole, so a source may pass its slots' words by less than one document. A document
    without words is kept once, since it changes no source's share."""
    mix = mixture(docs, block_words=block_words, max_repeat=max_repeat, carry=docs.columns, **options)
    # The slots of a source take its run from the start, so a turn has a piece if it starts before the words they take: no join
    # with the pieces is needed, which would shuffle all texts once more.
    taken = F.col("slots") * block_words
    turns = F.when(F.col("size") == 0, 1).otherwise(sum((F.col("at") + t * F.col("source_size") < taken).cast("int") for t in range(max_repeat)))
    copies = mix.placed.withColumn("_turns", turns).where("_turns > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
    return copies.select(*[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(docs.columns)])
