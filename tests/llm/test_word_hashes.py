"""Words that double themselves with two letters swapped (Thue-Morse words and their complements) are different words, of any
length, and rows that repeat key and text cost no more than one."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import jaccard, quality, substrings
from strandline.llm.textkit import PRIME, mulmod, window_hash, words_of


def thue_morse(n: int) -> tuple[str, str]:
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def hashes(*words: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = words_of(data, np.array([0, len(data)]), two=True)
    return w.h, w.h2


def test_words_of_any_length_differ():
    for n in (2, 16, 1024, 2048, 4096, 1 << 16):
        a, b = thue_morse(n)
        for h in hashes(a, b, a):
            assert h[0] == h[2] != h[1]
    # the same with words for letters, in windows of any length
    for n in (1024, 4096):
        a, b = (" ".join(x) for x in thue_morse(n))
        h, h2 = hashes(a, b)
        for k, x in ((0, h), (1, h2)):
            got = window_hash(x, n, k)
            assert got[0] != got[n]


def test_products_modulo_the_prime():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, int(PRIME), 500, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, int(PRIME) - 1, int(PRIME) - 1], [5, int(PRIME) - 1, 1]
    assert mulmod(a, b).tolist() == [int(x) * int(y) % int(PRIME) for x, y in zip(a, b)]


def test_operators_tell_long_words_apart(spark):
    rest = [f"w{i}" for i in range(40)]
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n)
        # 20 shingles of 38 have the long word in no place but the middle
        texts = [" ".join([*rest[:20], x, *rest[20:]]) for x in (a, b)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        # 36 of 42 shingles are common: no link at nine tenths
        assert {r.doc_id: r.component_id for r in jaccard.classes(docs, n=3, percent=90).collect()} == {0: 0, 1: 1}
        assert [r.n_removed for r in substrings.without_repeats(docs).orderBy("doc_id").collect()] == [0, 0]
        same = spark.createDataFrame([(0, texts[0]), (1, texts[0])], "doc_id bigint, text string")
        assert [r.n_removed for r in substrings.without_repeats(same).orderBy("doc_id").collect()] == [41, 41]
        line = " ".join(["x", "y", "z", "u", a, "x", "y", "z", "u", b, "p", "q", "r"])
        once = spark.createDataFrame([(0, line)], "doc_id bigint, text string")
        assert quality.with_statistics(once).first().n_repeat_words == 0


def test_many_rows_that_repeat_key_and_text(spark):
    text = " ".join(f"w{i % 90}" for i in range(200))
    docs = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    spans = substrings.repeated_windows(docs).collect()
    assert len(spans) == 1 and len(spans[0].spans) <= 200
    out = substrings.without_repeats(docs)
    assert [tuple(r) for r in out.groupBy("n_removed", "kept").count().collect()] == [(200, "", 3000)]


def test_a_key_named_as_an_inner_column(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (3, "a b c d e"), (5, "other words than those")], "node bigint, text string")
    assert {r.node: r.component_id for r in jaccard.classes(docs, key="node").collect()} == {7: 3, 3: 3, 5: 5}
