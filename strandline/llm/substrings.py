"""Operator 7: substring deduplication by seed and extend.

Seeds are winnowed anchors (Schleimer et al. 2003): of the k-word runs in each window of `length` words the one with the
least hash is its anchor, so equal windows have equal anchors at the same place. Each anchor owns the run of windows
that chose it. Anchors that occur once end there. The others extend both ways over the windows that they own: a whole
run of owned windows that occurs again (same anchor, same reach, same words) is repeated as it stands; other runs are
taken apart into their windows, each of which is looked up among the windows of equal anchors. Maximal repeats are the
unions of repeated windows.

Counting is by aggregates with map-side sums, so a passage in very many documents, or many copies, costs one row for
each task. Texts travel packed, keyed by (doc_id, 64-bit hash of the text); repeated rows share a key.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import plus, saved, table, tune
from strandline.llm.textkit import U64, slices, span_hash, window_hash, words_of

#: Words of a seed; a window of 35 words has 24 of them.
SEED_WORDS = 12


def _anchors(h: np.ndarray, doc: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): the anchors (index of the first word) and the windows that chose them."""
    m = len(h) - length + 1
    if m <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    seeds = window_hash(h, k)
    w = length - k + 1
    view = np.lib.stride_tricks.sliding_window_view(seeds, w)[:m]
    # the last of equal least hashes, so that runs of one word move on by one
    chosen = np.arange(m) + (w - 1 - view[:, ::-1].argmin(axis=1))
    ok = doc[:m] == doc[length - 1 :]
    start = np.flatnonzero(ok)
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e, e
    a = chosen[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    runs = np.flatnonzero(new)
    return a[runs], start[runs], np.append(start[runs[1:] - 1], start[-1])


def _seeds_of(text: pa.Array, length: int, k: int):
    """For each slice: row of each owned run, anchor hash, hash of the whole run, first window (word in its row), windows."""
    for at, _, data, bounds in slices(text):
        w = words_of(data, bounds, two=True)
        a, s, e = _anchors(w.h, w.doc, w.first, length, k)
        if len(a):
            seed = window_hash(w.h2, k, 1)[a]
            whole = span_hash(w.h, s, e + length) ^ (a - s).astype(np.uint64) * U64(0x9E3779B97F4A7C15)
            yield at + w.doc[a], seed, whole, s - w.first[w.doc[a]], e - s + 1


def _packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, z): key, hash of the text, packed text."""

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=6)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress((x or "").encode()) for x in b.column(2).to_pylist()], pa.binary())], [key, "t", "z"])

    some = df.select(key, F.xxhash64(F.lit(7), text).alias("t"), text)
    return some.mapInArrow(run, plus(df.select(key).schema, "t bigint, z binary"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 35, k: int = SEED_WORDS) -> DataFrame:
    """(key, t, spans): for each row with windows that start elsewhere too, their word ranges, packed as int32 pairs
    (first window, number of windows)."""
    kind = df.schema[key].dataType.simpleString()
    keyed = df.select(F.col(key).alias("k"), F.xxhash64(F.lit(7), text).alias("t"), text)

    def seeds(batches):
        for b in batches:
            for row, seed, whole, at, n in _seeds_of(b.column(2), length, k):
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), _signed(seed), _signed(whole), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["k", "t", "seed", "whole", "at", "n"])

    # adaptive execution splits the rows of a hot seed only if both sides of a join are shuffled for it; an aggregate by seed
    # that is joined back by seed would be taken as it lies, so these joins go by the seed's complement
    runs = keyed.mapInArrow(seeds, f"k {kind}, t bigint, seed bigint, whole bigint, at int, n int")
    often = runs.groupBy("seed").count().filter("count > 1").select(F.bitwise_not("seed").alias("s"))
    again = saved(runs.join(often, F.bitwise_not("seed") == F.col("s")).drop("s"))
    reach = again.groupBy("seed").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).select(F.bitwise_not("seed").alias("s"), (F.col("lo") == F.col("hi")).alias("alike"))
    again = saved(again.join(reach, F.bitwise_not("seed") == F.col("s")).drop("s"), again)
    # runs whose anchor also has other reaches or words around it: those that occur again as a whole stand
    mixed = again.filter("not alike")
    wholes = mixed.groupBy("seed", "whole").agg(F.count("*").alias("c"), F.min(F.struct("k", "t", "at")).alias("one"))
    wholes = wholes.select(F.bitwise_not("seed").alias("s"), F.col("whole").alias("w"), "c", "one")
    mixed = mixed.join(wholes, (F.bitwise_not("seed") == F.col("s")) & (F.col("whole") == F.col("w"))).drop("s", "w")
    # one of the equal runs speaks for all of them when windows are counted
    mixed = mixed.withColumn("speaks", F.col("one").eqNullSafe(F.struct("k", "t", "at"))).drop("one")
    # as sets, since rows that repeat key and text say the same
    apart = mixed.filter("speaks").groupBy("k", "t").agg(F.collect_set(F.struct("at", "n", "seed", "c")).alias("runs"))
    packed = _packed(df.select(F.col(key).alias("k"), text), "k", text).withColumnsRenamed({"k": "k2", "t": "t2"}).dropDuplicates(["k2", "t2"])
    texts = apart.join(packed, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2"))).select("k", "t", "runs", "z")

    def windows(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                data = np.frombuffer(d.decompress(b.column(3)[i].as_py()), np.uint8)
                w = words_of(data, np.array([0, len(data)]), two=True)
                r = b.column(2)[i].values
                at, n, seed, c = (np.asarray(r.field(x)) for x in ("at", "n", "seed", "c"))
                one, two = window_hash(w.h, length), window_hash(w.h2, length, 1)
                of = np.repeat(np.arange(len(at)), n)
                start = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                # two independent hashes of words and windows: over 120 bits stand for the words of a window
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(of)), pa.repeat(b.column(1)[i], len(of)), _signed(one[start]), _signed(two[start] ^ seed[of].view(np.uint64)), pa.array(start.astype(np.int32)), pa.array(np.minimum(c[of], 2).astype(np.int32))], ["k", "t", "one", "two", "at", "c"])

    parts = saved(texts.mapInArrow(windows, f"k {kind}, t bigint, one bigint, two bigint, at int, c int"))
    seen = parts.groupBy("one", "two").agg(F.sum("c").alias("total")).filter("total > 1").select(F.bitwise_not("one").alias("o"), F.col("two").alias("w"))
    hit = parts.filter("c = 1").join(seen, (F.bitwise_not("one") == F.col("o")) & (F.col("two") == F.col("w"))).select("k", "t", "at", F.lit(1).alias("n"))
    stand = again.filter("alike").select("k", "t", "at", "n").union(mixed.filter("c > 1").select("k", "t", "at", "n"))
    return stand.union(hit).groupBy("k", "t").agg(F.collect_set(F.struct("at", "n")).alias("spans")).select(F.col("k").alias(key), "t", "spans")


def _kept(data: bytes, at: np.ndarray, n: np.ndarray, length: int) -> tuple[int, int, list[bytes]]:
    words = data.split()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n + length - 1, -1)
    gone = np.cumsum(cover)[: len(words)] > 0
    return len(words), int(gone.sum()), [words[i] for i in np.flatnonzero(~gone)]


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 35, k: int = SEED_WORDS) -> DataFrame:
    """(key, n_words, n_removed, kept): each row's words without those in a window of `length` words whose sequence
    also starts elsewhere, joined by one blank.

    Null and empty texts have no words. Repeated rows repeat each other's windows; a null key is a key like others; other
    columns are passed over, whatever their names; an empty table gives no rows."""
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    found = repeated_windows(df, "k", "text", length, k).withColumnsRenamed({"k": "k2", "t": "t2"})
    packed = _packed(df, "k", "text")
    both = packed.join(found, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left").select("k", "z", "spans")

    def run(batches):
        import zstandard

        d, none = zstandard.ZstdDecompressor(), np.empty(0, np.int64)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                r = b.column(2)[i].values
                at, n = (np.asarray(r.field(x)) for x in ("at", "n")) if r is not None else (none, none)
                rows.append(_kept(d.decompress(b.column(1)[i].as_py()), at, n, length))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([b" ".join(r[2]).decode() for r in rows], pa.string())], [key, "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"{key} {kind}, n_words bigint, n_removed bigint, kept string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
