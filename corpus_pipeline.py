"""A training corpus from `documents`, in stages: toxic documents go, one document of each near-duplicate
group stays, documents with benchmark items go, sources are mixed to their weights, rows get shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for all stages: a null text counts as empty, is clean, near to nothing, holds no benchmark item, has no words and goes
to a shard; a null id is an id like others (near_dedup decides by id: rows that share one, null included, stay if one of them would); a null source
is a source of its own, the last; rows repeated in full are kept alike until mix, where each counts; very long texts are read whole; an empty
table stays empty; columns beside doc_id, text and source pass through, but for those called like a column that shard adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelake.llm.common import table, written
from usagelake.llm.decontaminate import decontaminated
from usagelake.llm.mixing import mixed_documents
from usagelake.llm.near_dedup import deduplicated
from usagelake.llm.sharding import assign_shards
from usagelake.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores at 0.7 or more; it learns from the labelled rows of documents."""
    net = fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by 5-word shingles at a similarity of 0.8."""
    return deduplicated(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until each source has its share; a document comes at most twice."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard, grown_shard and slot: 16 shards by rendezvous hashing of the id."""
    return assign_shards(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Training and sketches can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
