"""Importance resampling towards a target distribution over hashed n-grams.

1. Each partition counts the features of its texts with DuckDB: words by regular expression, unnested, n-grams by window,
   buckets by a registered zlib CRC-32; a text's bucket counts go to a Parquet table of the run.
2. Spark sums that table to one count for each bucket, for the documents and for the target, and makes a gain of the two:
   floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), S and T being the features of all texts.
3. A document's weight is the floored mean of its features' gains. Its score adds Gumbel noise drawn from a hash of its
   id, so that the highest scores are a sample without replacement in proportion to exp(weight / 1000).
4. Ranks come from a histogram of scores. Scores are integers between the logarithms of counts, so it has some 100,000
   rows at most, and a score that is drawn holds at most one in 2700 of the ids of one weight, by the noise's density: no task
   orders all documents. Rows that agree in all that is returned are counted as one before they are ranked.

On the driver are only the gains, one number for each bucket, a parameter.

Defined cases: a null text has no words; a text without features has weight 0; a null id is drawn like the text "null", ranks
after other ids on ties, and rows that share an id share its noise; rows repeated in full each have a rank; an empty table
gives an empty table; without a target all counts of it are 0. Texts are counted whole, in slices of SLICE bytes of texts;
of other columns only the key is read, so no name can clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import before, scratch, written
from usagelake.llm.slices import sliced

#: Bytes of text that one DuckDB query counts.
SLICE = 8 << 20
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNTED = "id long, n_words long, n_features long, buckets array<int>, counts array<int>"
#: Scores of one cell of the histogram.
CELL = 64


def count_query(max_n: int, n_buckets: int) -> str:
    """DuckDB SQL over the view `slice` (row, text): the bucket counts of each row."""
    grams = ["select row, word as feature from words"]
    for n in range(2, max_n + 1):
        following = ", ".join(f"lead(word, {k}) over w" for k in range(1, n))
        grams.append(f"select row, feature from (select row, word || ' ' || concat_ws(' ', {following}) as feature, lead(word, {n - 1}) over w as final from words window w as (partition by row order by place)) where final is not null")
    return f"""
    with split as (select row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as list from slice),
    words as (select row, unnest(list) as word, generate_subscripts(list, 1) as place from split),
    grams as ({" union all ".join(grams)}),
    times as (select row, feature, count(*) as n from grams group by row, feature),
    hashed as (select feature, (crc(feature) % {n_buckets})::int as bucket from (select distinct feature from times)),
    filled as (select row, bucket, sum(n)::int as n from times join hashed using (feature) group by row, bucket),
    rows as (select row, list(bucket order by bucket) as buckets, list(n order by bucket) as counts, sum(n)::bigint as n_features from filled group by row)
    select row, len(list)::bigint as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(buckets, []::int[]) as buckets, coalesce(counts, []::int[]) as counts
    from split left join rows using (row) order by row"""


def crc(features: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f) for f in features.cast(pa.binary()).to_pylist()], pa.int64())


def counter(max_n: int, n_buckets: int):
    query = count_query(max_n, n_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from duckdb import sqltypes

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""}) as db:
            db.create_function("crc", crc, [sqltypes.VARCHAR], sqltypes.BIGINT, type="arrow")
            for piece in sliced(batches, "text", SLICE):
                texts = pa.table({"row": pa.array(range(piece.num_rows), pa.int32()), "text": piece["text"].fill_null("")})
                db.register("slice", texts)
                rows = db.sql(query).to_arrow_table().combine_chunks()
                db.unregister("slice")
                columns = [piece["id"], *(rows[c].combine_chunks() for c in ("n_words", "n_features", "buckets", "counts"))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "buckets", "counts"])

    return count


def bucket_counts(texts: DataFrame, max_n: int = 1, n_buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_features, buckets and counts (two arrays of the same length) for each row, written as a table."""
    rows = texts.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return written(rows.mapInArrow(counter(max_n, n_buckets), COUNTED), "resample-counts")


def totals(counted: DataFrame) -> DataFrame:
    """bucket, n: what all texts hold."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(documents: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, gain for each bucket, from the totals of both sides."""
    every = documents.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = Window.partitionBy()
    ours, theirs = (F.sum(c).over(sums).cast("double") for c in ("s", "t"))
    ratio = (F.col("t").cast("double") + 1.0) * (ours + float(n_buckets)) / ((F.col("s").cast("double") + 1.0) * (theirs + float(n_buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    exact = (total - F.pmod(total, n)) / n
    return F.when(n > 0, exact.cast("long")).otherwise(F.lit(0).cast("long"))


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256("seed:key")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")


def scored(counted: DataFrame, gain: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """id, n_words, n_features, weight, score for each counted row."""
    table = [0] * n_buckets
    for row in gain.collect():
        table[row.bucket] = row.gain
    # A literal array: folded once, so no row carries it.
    found = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get(found, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = counted.withColumn("weight", floored_mean(total, F.col("n_features"))).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return rows.select("id", "n_words", "n_features", "weight", "score")


def ranked(rows: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Adds rank to the rows of `scored`: 1, 2, ... by score down and id up for the best percent of those with min_words words."""
    long_enough = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    same = ["id", "n_features", "weight", "score"]
    alike = rows.where(long_enough).groupBy(*same).agg(F.count("*").alias("copies"))
    levels = alike.groupBy("score").agg(F.sum("copies").alias("n")).withColumn("down", -F.col("score")).withColumn("cell", F.floor(F.col("down") / CELL))
    levels = written(before(levels, [], "cell", ["down"], F.col("n"), "above").select("score", "n", "above"), "resample-levels")
    drawn = (levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    lowest = levels.where(F.col("above") < drawn).agg(F.min("score")).first()[0]
    in_play = long_enough & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    rest = rows.where(~in_play).select(*same, F.lit(None).cast("long").alias("rank"))
    if lowest is None:
        return rest
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    high = alike.where(F.col("score") >= F.lit(lowest)).join(levels.select("score", "above"), "score")
    high = high.withColumn("place", F.col("above") + F.coalesce(F.sum("copies").over(order), F.lit(0)))
    high = high.withColumn("rank", F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("copies"))))
    return rest.unionByName(high.select(*same, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))


def importance_ranks(
    docs: DataFrame, target: DataFrame, max_n: int = 1, n_buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024,
    key: str = "doc_id", text: str = "text", target_key: str | None = None, target_text: str = "text",
) -> DataFrame:
    """key, n_features, weight, score and rank (null where not drawn) for each row of docs, drawn towards the texts of target."""
    with scratch() as tables:
        counted = bucket_counts(docs, max_n, n_buckets, key, text)
        aims = target.select(F.lit(None).alias("key") if target_key is None else F.col(f"`{target_key}`").alias("key"), F.col(f"`{target_text}`").alias("text"))
        aimed = bucket_counts(aims, max_n, n_buckets, "key", "text")
        rows = tables.keep(written(scored(counted, gains(totals(counted), totals(aimed), n_buckets), n_buckets, seed), "resample-scores"))
    return ranked(rows, min_words, percent).withColumnRenamed("id", key)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns. Rows that share an id come together if one of them is drawn."""
    drawn = importance_ranks(docs, target, key=key, **options).where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(drawn, docs[f"`{key}`"].eqNullSafe(drawn["_drawn"]), "left_semi")
