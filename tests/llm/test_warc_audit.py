"""The audit opens only branches that differ, and a file with very many records is laid out by ranges."""

from pyspark.sql import functions as F

from strandline.llm import warc

PAGES = "page_id bigint, url string, html string"


def test_only_unlike_branches_are_opened(spark):
    rows = [(f, 100 * i, f"d{f}-{i}") for f in range(3) for i in range(400)]
    a = spark.createDataFrame(rows, "file bigint, offset bigint, digest string")
    b = a.withColumn("digest", F.when((F.col("file") == 1) & (F.col("offset") == 12_300), "bad").otherwise(F.col("digest")))
    damage, _ = warc.audit(a, b, range_bytes=512, fan=3)
    assert [tuple(r) for r in damage.collect()] == [(1, 12_300, "corrupt")]
    # each level's nodes are semi-joined with the parents that differ
    assert "LeftSemi" in damage._jdf.queryExecution().toString()
    more = a.union(spark.createDataFrame([(7, 1 << 40, "x")], a.schema))
    assert [tuple(r) for r in warc.audit(a, more, range_bytes=512, fan=3)[0].collect()] == [(7, 1 << 40, "extra")]
    assert [tuple(r) for r in warc.audit(more, a, range_bytes=512, fan=3)[0].collect()] == [(7, 1 << 40, "missing")]


def test_layout_of_repeated_and_null_ids(spark):
    rows = [(5, "u", "x" * (i % 7)) for i in range(500)] + [(None, None, None)] * 300 + [(-1, "n", "neg"), (-1000, "n", "neg"), (4, "a", None), (6, "z", "")]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], PAGES + ", offset int, file string").repartition(4)
    out = warc.laid_out(pages, F.col("html"), per_file=1000).collect()
    assert len(out) == len(rows) and {r.file for r in out} == {0, -1, warc.NULL_FILE}
    for f in {r.file for r in out}:
        at = 0
        for r in sorted((r for r in out if r.file == f), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    ids = [r.page_id for r in sorted((r for r in out if r.file == 0), key=lambda r: r.offset)]
    assert ids == sorted(ids)
    assert warc.laid_out(pages.limit(0), F.col("html")).count() == 0
