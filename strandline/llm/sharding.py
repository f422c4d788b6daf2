"""Operator 10: a global shuffle into shards in two passes.

Pass 1 scatters rows uniformly into buckets that fit in memory, by a seeded hash of each row's place in the input, and
writes them to the shared folder: equal or repeated rows do not meet in one bucket, and a lost executor re-reads the
written buckets, never a new scatter. Pass 2 runs a seeded Fisher-Yates shuffle over each bucket. A row's place in the
global order is its bucket's first place plus its place in the bucket; shard = place mod shards, slot = place div
shards, so shards differ by one row at most and slots have no gaps (law `rows`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import scratch, table, tune

BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of n places: Fisher-Yates with its draws made at once."""
    order = np.arange(n)
    rng = np.random.default_rng([seed, bucket])
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with as many _ in front as none of df's columns has."""
    lead = ""
    while any(c.lower() in {(lead + w).lower() for w in wanted} for c in df.columns):
        lead += "_"
    return [lead + w for w in wanted]


def _before(counts: DataFrame, bucket: str, n: str, block: int = 4096) -> DataFrame:
    """counts (a row a bucket) with `before`, the sum of n over all earlier buckets: running sums inside blocks of buckets
    and over the blocks, of which there is a row each."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    each = counts.select(F.col(bucket).alias("b"), F.col(n).alias("n"), F.floor(F.col(bucket) / block).alias("block"))
    blocks = each.groupBy("block").agg(F.sum("n").alias("total"))
    blocks = blocks.select(F.col("block").alias("k"), F.coalesce(F.sum("total").over(ahead(Window.orderBy("block"))), F.lit(0)).alias("lead"))
    own = F.coalesce(F.sum("n").over(ahead(Window.partitionBy("block").orderBy("b"))), F.lit(0))
    return each.withColumn("own", own).join(blocks, F.col("block") == F.col("k")).select(F.col("b"), (F.col("lead") + F.col("own")).cast("bigint").alias("before"))


def shuffle(df: DataFrame, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, text: str = "text", place: str = "place") -> DataFrame:
    """df in a seeded random order: each row gets its place, from 0 without gaps. All columns stay; one named place is
    replaced. Rows with nulls, empty texts and repeats are rows like others; an empty table stays empty."""
    spark = df.sparkSession
    df = df.drop(place)
    bucket, key, b, before = _names(df, "bucket", "key", "b", "before")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bucket_bytes))
    placed = df.withColumn(key, F.monotonically_increasing_id())
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)).cast("int"))
    path = scratch(spark, "buckets")
    placed.repartition(F.col(bucket)).write.parquet(path)
    first = spark.read.parquet(path)
    start = _before(first.groupBy(bucket).agg(F.count("*").alias("n")), bucket, "n").toDF(b, before)
    kept = [f for f in first.schema.fields if f.name not in (bucket, key)]

    def mixed(t: pa.Table, lead: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        order = fisher_yates(t.num_rows, seed, t.column(bucket)[0].as_py())
        return t.drop_columns([bucket, key]).append_column(place, pa.array(order + lead.column(before)[0].as_py(), pa.int64()))

    # a bucket and its first place come together by one shuffle of the written rows
    both = first.groupBy(bucket).cogroup(start.groupBy(b))
    return both.applyInArrow(mixed, T.StructType([*kept, T.StructField(place, T.LongType())]))


def into_shards(df: DataFrame, shards: int, seed: int = 20, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard and slot by law `rows`; columns of these names are replaced. See shuffle()."""
    df = df.drop("shard", "slot")
    (spot,) = _names(df, "spot")
    out = shuffle(df, seed, bucket_bytes, text, spot)
    return out.withColumn("shard", (F.col(spot) % shards).cast("int")).withColumn("slot", F.floor(F.col(spot) / shards).cast("bigint")).drop(spot)


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 20, text: str = "text") -> None:
    """Writes the shards as folders shard=0, shard=1 ...; a shard's files hold its rows in order of slot and are cut by
    ranges of slots, so that no task writes a whole shard."""
    out = into_shards(df, shards, seed, text)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = into_shards(docs, 24)
    return out.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
