"""Operator 3: Merkle fixity audit of WARC replicas, in DataFrame operations.

Each record's digest is a leaf. Leaves of a file are grouped by ordered ranges of offsets, ranges by FAN into wider
ranges, up to one root for each file: trees over offset ranges need no running number, so a file of any size is built
in parallel. An audit compares the roots of two replicas and goes down only into branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.llm.common import saved, table

RANGE_BYTES, FAN, DEPTH = 1 << 16, 16, 4
#: Pages in a WARC file as the query lays it out; no file is written.
FILE_PAGES = 1000
#: The file of pages without id, far below those of any id.
NULL_FILE = -(1 << 62)


def record_of(url: Column, html: Column) -> Column:
    """A page as a WARC response record; null counts as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN, depth: int = DEPTH, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Inner nodes (keys, level, node, hash) of records (keys, offset, digest): level 0 are ranges of range_bytes offsets,
    level depth is the root if the file has less than range_bytes * fan ** depth bytes. keys name a file.

    A node's hash is the SHA-256 of its children's, in order of offset. Repeated offsets are ordered by digest."""
    kids = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: s["h"]), "")
    level = records.groupBy(*keys, F.floor(F.col("offset") / range_bytes).alias("node")).agg(F.sha2(kids([F.col("offset"), F.col("digest").alias("h")]), 256).alias("hash"))
    out = level = saved(level.withColumn("level", F.lit(0)), free=False)
    for k in range(1, depth + 1):
        up = level.groupBy(*keys, F.floor(F.col("node") / fan).alias("up")).agg(F.sha2(kids([F.col("node"), F.col("hash").alias("h")]), 256).alias("hash"))
        level = up.select(*keys, F.col("up").alias("node"), "hash", F.lit(k).alias("level"))
        out = out.unionByName(level)
    return saved(out, free=False)


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(damage, tree of a): damage has (file, offset, status) of the records of replicas a and b (file, offset, digest)
    that differ: status is corrupt, missing (in b) or extra (only in b). depth: of the trees, by default as deep as gives
    each file one root.

    Roots are compared first. A level's nodes meet only below parents that differ, and records only in ranges that
    differ, so branches that agree are never opened. Empty replicas have no damage; a repeated (file, offset) counts once
    for each kind of damage there."""
    both = a.select("file", "offset", "digest", F.lit(True).alias("mine")).union(b.select("file", "offset", "digest", F.lit(False)))
    if depth is None:
        depth = levels_for(both, range_bytes, fan, DEPTH)
    trees = tree(both, range_bytes, fan, depth, ("mine", "file"))
    nodes = trees.select("file", "level", "node", F.floor(F.col("node") / fan).alias("up"), F.when(F.col("mine"), F.col("hash")).alias("x"), F.when(~F.col("mine"), F.col("hash")).alias("y"))

    def unlike(k: int, parents: DataFrame | None) -> DataFrame:
        opened = nodes.filter(F.col("level") == k)
        if parents is not None:
            opened = opened.join(parents.withColumnRenamed("node", "up"), ["file", "up"], "left_semi")
        return opened.groupBy("file", "node").agg(F.max("x").alias("x"), F.max("y").alias("y")).filter(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")

    bad = unlike(depth, None)
    for k in range(depth - 1, -1, -1):
        bad = unlike(k, bad)
    bad = saved(bad, free=False)
    part = lambda r, h: r.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["file", "node"], "left_semi").select("file", "offset", F.col("digest").alias(h))
    found = part(a, "x").join(part(b, "y"), ["file", "offset"], "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return found.select("file", "offset", status.alias("status")).distinct(), trees.filter("mine").drop("mine")


def laid_out(pages: DataFrame, html: Column, per_file: int = FILE_PAGES) -> DataFrame:
    """pages (page_id, url, html) as records (page_id, file, offset, length, digest) of WARC files of per_file page ids;
    digest is of the record with the given html in it. Null ids go to a file of their own, NULL_FILE; other columns of
    pages are passed over; an empty table gives no records.

    A file's records stand in order of page_id, length and digest. Their offsets are running sums in two steps, over
    ranges of that order and within each, so that a file with very many records (one id that repeats, say) is shared by
    many tasks."""
    record = record_of(F.col("url"), html)
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(NULL_FILE)).alias("file"), F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"), F.sha2(record_of(F.col("url"), F.col("html")), 256).alias("_as"))
    order = ["page_id", "length", "_as", "_tie"]
    rows = saved(rows.withColumn("_tie", F.monotonically_increasing_id()), free=False)
    rows = saved(rows.repartitionByRange("file", *order).withColumn("_range", F.spark_partition_id()), rows, free=False)
    ahead = lambda *keys: W.Window.partitionBy(*keys).rowsBetween(W.Window.unboundedPreceding, -1)
    # a row for each range that a file has records in
    sums = rows.groupBy("file", "_range").agg(F.sum("length").alias("bytes"))
    sums = sums.select(F.col("file").alias("_f"), F.col("_range").alias("_r"), F.coalesce(F.sum("bytes").over(ahead("file").orderBy("_range")), F.lit(0)).alias("_from"))
    out = rows.join(sums, (F.col("file") == F.col("_f")) & (F.col("_range") == F.col("_r")))
    own = F.coalesce(F.sum("length").over(ahead("file", "_range").orderBy(*order)), F.lit(0))
    return out.select("page_id", "file", (F.col("_from") + own).cast("bigint").alias("offset"), "length", "digest")


def levels_for(records: DataFrame, range_bytes: int, fan: int, depth: int) -> int:
    """The least depth, but no less than the given one, at which every file has one node."""
    last = (records.agg(F.max("offset")).first()[0] or 0) // range_bytes
    while last >= fan**depth:
        depth += 1
    return depth


def roots_of(tree_: DataFrame, depth: int) -> DataFrame:
    """(f, file_root): each file's only node at the first level, from depth on, where it has no other."""
    top = tree_.filter(F.col("level") >= depth).groupBy("file", "level").agg(F.count("*").alias("n"), F.min("hash").alias("hash"))
    return top.filter("n = 1").groupBy(F.col("file").alias("f")).agg(F.min_by("hash", "level").alias("file_root"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with the verdict of an audit against a replica in which some records have other bytes."""
    pages = table(spark, sf_dir, "pages")
    a = saved(laid_out(pages, F.col("html")), free=False)
    b = saved(laid_out(pages, F.when(F.col("page_id") % 97 == 13, F.translate("html", "a", "b")).otherwise(F.col("html"))), free=False)
    damage, tree_a = audit(a, b)
    roots = roots_of(tree_a, DEPTH)
    damage = damage.select(F.col("file").alias("f2"), F.col("offset").alias("o2"), "status")
    out = a.join(roots, F.col("file") == F.col("f")).join(damage, (F.col("file") == F.col("f2")) & (F.col("offset") == F.col("o2")), "left")
    return out.select("page_id", "file", "offset", "length", "digest", "file_root", F.coalesce("status", F.lit("intact")).alias("status"))


def _level(k: int) -> str:
    return f"l{k} AS (SELECT file, node // {FAN} AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM l{k - 1} GROUP BY ALL)"


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({html}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"
OP3_SQL = f"""
WITH r AS (SELECT page_id, CAST(coalesce(page_id // {FILE_PAGES}, {NULL_FILE}) AS BIGINT) AS file, {_RECORD.format(html="html")} AS a, {_RECORD.format(html="CASE WHEN page_id % 97 = 13 THEN translate(html, 'a', 'b') ELSE html END")} AS b FROM pages),
s AS (SELECT page_id, file, CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS digest, sha256(b) AS other FROM r),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, length, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s),
l0 AS (SELECT file, "offset" // {RANGE_BYTES} AS node, sha256(string_agg(digest, '' ORDER BY "offset")) AS hash FROM o GROUP BY ALL),
{", ".join(_level(k) for k in range(1, DEPTH + 1))}
SELECT page_id, o.file, "offset", length, digest, l{DEPTH}.hash AS file_root, CASE WHEN digest = other THEN 'intact' ELSE 'corrupt' END AS status
FROM o JOIN l{DEPTH} ON o.file = l{DEPTH}.file
"""
