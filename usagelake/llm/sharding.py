"""Sharding by weighted rendezvous hashing of stable record keys; built-in functions only.

Each shard s gets the score -ln(u) / weight, where u in (0, 1) comes from the first 52 bits of
md5(seed, key, s); the record goes to the shard with the least score, ties to the smaller number.
Whatever the other shards are, a score depends on key and shard alone, so one more shard takes over
the records it wins and no other record moves.

Defined cases: a null key is a key of its own (all such rows share a shard); a null text has no bytes;
rows repeated in full each get a slot; an empty table gives an empty table; columns of the input that
are called like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import before, hex_cell, without

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def key_text(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The number of the shard that wins key; weights has one positive number for each shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("each shard needs a positive weight")
    heavy = F.array(*[F.lit(float(w)) for w in weights])

    def bid(shard: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), key, shard.cast("string")).cast("binary"))
        unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
        return F.struct((-F.log(unit) / F.element_at(heavy, shard + 1)).alias("score"), shard.alias("shard"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), bid))["shard"]


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, seed: str = "shard") -> DataFrame:
    """The rows of docs with size (UTF-8 bytes + 1), text_crc32, law, shard, grown_shard and slot.

    slot counts the rows of a shard from 0 without gaps, in the order of a digest of key and content.
    The numbering is made in CELLS cells for each shard and never orders a whole shard in one task.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = without(docs, *(c for c in ADDED if c not in (key, text)))
    rows = rows.withColumn("size", F.octet_length(body).cast("long") + 1).withColumn("text_crc32", F.crc32(body)).withColumn("law", F.lit("key"))
    rows = rows.withColumn("shard", rendezvous(key_text(key), weights, seed)).withColumn("grown_shard", rendezvous(key_text(key), [*weights, grown_weight], seed))
    place = F.md5(F.concat_ws(":", F.lit(seed), key_text(key), F.col("text_crc32"), F.col("size")).cast("binary"))
    # The row travels as one column, so its names can't clash with those of the numbering.
    placed = rows.select(F.struct("*").alias("row"), "shard", place.alias("place")).withColumn("cell", hex_cell(F.col("place")))
    return before(placed, ["shard"], "cell", ["place"], F.lit(1).cast("long"), "slot").select("row.*", "slot")
