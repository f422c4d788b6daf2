"""Plumbing of the corpus operators: reading, written tables, components of a graph, bounded sketches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(schema: T.StructType, more: str) -> T.StructType:
    """schema with the fields of a DDL text behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded rows: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = f"{tempfile.gettempdir()}/strandline-checkpoints"
    return folder


def saved(df: DataFrame, *done: DataFrame, free: bool = True) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage is cut and lost executors cost nothing that
    came before. done: tables from saved() that nothing but df uses any more; they are deleted. free: the driver collects
    garbage, as Spark deletes shuffle files only then; needed where shuffles are large."""
    spark = df.sparkSession
    path = scratch(spark, "saved")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    for x in done:
        dropped(x)
    if free:
        spark.sparkContext._jvm.System.gc()
    return out


def dropped(x: DataFrame) -> None:
    """Deletes a table from saved() that nothing uses any more."""
    context = x.sparkSession.sparkContext
    old = context._jvm.org.apache.hadoop.fs.Path(x.saved_path)
    old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges: root is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) over DataFrames; the minimum of each
    neighbourhood is a partial aggregate and is joined back, so that a node with very many neighbours is split by
    adaptive execution. Each round is written. Rounds grow with the logarithm of the nodes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = saved(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u's smaller neighbours and u itself hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        e = saved(small.filter("u <> v").distinct(), e)
        # stars, when no node hangs on two others or on one that hangs itself
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(e.select(F.col("v"), F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if not ends.filter("hangs > 1 OR hangs = 1 AND holds = 1").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def sketch(df: DataFrame, bins_of: Callable[[pa.RecordBatch], np.ndarray], bins: int, parts: int = 64, fan: int = 64) -> np.ndarray:
    """About how many values fall in each of a fixed number of bins, as round(8 * log2(1 + count)) in a byte.

    bins_of gives the bin numbers of a batch. A task adds up its own counts and sends them compressed, so what travels
    is at most tasks x bins bytes; sums go through a level of at most fan groups, of 16 tasks or more each, before the last; bins bytes reach the driver,
    whatever the input.
    """
    width = bins // parts

    def local(batches):
        from pyspark import TaskContext

        # a byte each while they last: a bin that reaches 255 here counts as 255 of this task
        counts = np.zeros(bins, np.uint8)
        for batch in batches:
            at, n = np.unique(bins_of(batch), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)
        rows = [(p, zlib.compress(c.tobytes(), 1)) for p in range(parts) if (c := counts[p * width : (p + 1) * width]).any()]
        if rows:
            salt = TaskContext.get().partitionId() // 16 % fan
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "salt", "counts"])

    def total(t: pa.Table, kind: type) -> np.ndarray:
        out = np.zeros(width, np.uint64)
        for c in t.column("counts"):
            out += np.frombuffer(zlib.decompress(c.as_py()), kind)
        return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)

    def some(key, t):
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total(t, np.uint8).tobytes(), 1)], pa.binary())})

    def all_(key, t):
        level = np.minimum(255, np.round(8 * np.log2(1.0 + total(t, np.uint32)))).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    out = np.zeros(bins, np.uint8)
    sums = df.mapInArrow(local, "part int, salt int, counts binary").groupBy("part", "salt").applyInArrow(some, "part int, counts binary")
    for part, levels in sums.groupBy("part").applyInArrow(all_, "part int, levels binary").collect():
        out[part * width : (part + 1) * width] = np.frombuffer(zlib.decompress(levels), np.uint8)
    return out
