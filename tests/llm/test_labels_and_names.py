"""Labels that contradict or repeat, and columns named as an operator's own."""

import random

from pyspark.sql import functions as F

from strandline.llm import quality, sharding, substrings, toxicity


def test_labels_of_both_kinds_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 4) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] * 2 + [(1, 0, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.quality for r in quality.training_rows(docs, labels).collect()}
    assert got == {i: i % 2 for i in range(10) if i not in (1, 2)}
    seen = []
    fit = toxicity.fit_crf
    try:
        toxicity.fit_crf = lambda form, head, first, toxic: seen.append((len(first) - 1, int(toxic.sum()))) or fit(form, head, first, toxic)
        # a key with very many texts is one training document
        toxicity.fit(docs.union(docs.filter("doc_id = 4").withColumn("text", F.explode(F.array_repeat(F.lit("other words of doc four"), 500)))), labels)
    finally:
        toxicity.fit_crf = fit
    assert seen and seen[0][0] <= 8


def test_context_of_a_token(spark):
    import numpy as np

    left, right = toxicity.neighbours(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]), 9)
    assert list(left) == [9, 1, 2, 9] and list(right) == [2, 3, 9, 9]


def test_shards_keep_columns_of_any_name(spark):
    names = ["bucket", "_bucket", "key", "at", "_at", "b", "before", "spot", "Place"]
    df = spark.createDataFrame([(i, "t" * i, *range(len(names))) for i in range(200)], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names if n != "Place") + ", other int")
    out = sharding.into_shards(df, 7)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sorted(map(tuple, out.drop("shard", "slot").collect())) == sorted(map(tuple, df.collect()))


def test_places_over_many_blocks(spark):
    rng = random.Random(1)
    n = {b: rng.randint(1, 9) for b in rng.sample(range(40_000), 3000)}
    got = {r.b: r.before for r in sharding._before(spark.createDataFrame(list(n.items()), "bucket int, n bigint"), "bucket", "n", block=64).collect()}
    at = 0
    for b in sorted(n):
        assert got[b] == at
        at += n[b]


def test_substrings_of_odd_tables(spark):
    """Keys named as the operator's own columns, a very long text, a key with very many rows."""
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:150])), *[(3, " ".join(words[7000:7040]))] * 300, (None, "short")]
    for key in ("k", "t", "z", "spans", "seed"):
        df = spark.createDataFrame(rows, f"{key} bigint, text string")
        got = {(r[0], r.n_words, r.n_removed) for r in substrings.without_repeats(df, key).collect()}
        assert got == {(1, 60_000, 90), (2, 50, 50), (3, 40, 40), (None, 1, 0)}
