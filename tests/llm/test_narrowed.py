"""Groups of near-duplicate candidates that only rare words hold together."""

import numpy as np
import pytest

from strandline.llm import jaccard
from test_llm import brute_classes


@pytest.mark.parametrize("rows_of_list", [1 << 13, 4])
def test_chained_groups_are_narrowed(spark, monkeypatch, rows_of_list):
    """Unlike texts, each of which shares one passage with the next, are one group; blocks of it must not all meet."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)
    monkeypatch.setattr(jaccard, "LIST_ROWS", rows_of_list)
    rng, rows = np.random.default_rng(3), []
    for d in range(160):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        rows.append((d, " ".join([f"p{d // 12}x{k}" for k in range(3)] + words + [f"p{d // 12 + 1}x{k}" for k in range(3)])))
    for d in range(160, 190):
        words = rows[d - 160][1].split()
        words[30] = f"other{d}"
        rows.append((d, " ".join(words)))
    sent, links = [], jaccard._block_links

    def counted(df, n, percent):
        sent.append(df.count())
        return links(df, n, percent)

    monkeypatch.setattr(jaccard, "_block_links", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.classes(df, n=3, percent=85, bins=1 << 16).collect())) == brute_classes(rows, 3, 85)
    assert sum(sent) <= 2 * len(rows)


@pytest.mark.parametrize("n, percent", [(40, 90), (400, 80), (9000, 90)])
def test_parities_never_lose_a_link(n, percent):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        out = n * (100 - percent) // (100 + percent)
        b = np.concatenate([a[out:], rng.integers(0, 1 << 63, out).astype(np.uint64)])
        assert 100 * (n - out) >= percent * (n + out)
        x, y = jaccard.parities(a, percent), jaccard.parities(b, percent)
        far = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(jaccard._folded(y, len(x)), np.uint64)).sum())
        assert far * (100 + percent) <= 2 * n * (100 - percent)
