"""Lagged sums over blocks of the matrix: against plain kernels over whole series, and no row for each pair and time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import lags as L
from strandline.operators import seams as E
from strandline.operators import stats as S
from strandline.schema import DiscoverySettings


def sparse(spark, n=400):
    """b has long gaps, so that lags reach over several blocks; rare has a value in few blocks; c steps evenly."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=n), np.cumsum(rng.normal(size=n))
    rows = [(float(i), float(a[i]), float(b[i]) if i < 60 or 290 < i else None, float(a[i]) if i % 53 == 0 else None, i * 0.1, 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "ts double, a double, b double, rare double, c double, still double").repartition(3)


@pytest.mark.parametrize("rows", [25, 1 << 16])
def test_lags_over_blocks_of_the_matrix(spark, rows):
    df, lag = sparse(spark), 9
    pairs = [("a", "b"), ("rare", "a"), ("a", "c"), ("a", "still")]
    s = DiscoverySettings(max_lag=lag, jump_z=1.5)
    seamed = E.seams(df, "ts", pairs, lag, rows)
    got = {(r.a, r.b, r.lag): r for r in S.cross_correlations(df, "ts", pairs, lag, seamed).collect()}
    found = {(r.source, r.target): r for r in L.trigger_scores(df, "ts", pairs, s, seamed).collect()}
    for a, b in pairs:
        p = df.orderBy("ts").select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().toPandas()
        x, y = p.x.to_numpy(), p.y.to_numpy()
        assert {r.n for k, r in got.items() if k[:2] == (a, b)} == {len(x)} and got[a, b, 0].coverage == pytest.approx(len(x) / 400)
        if b == "still":
            assert all(got[a, b, k].r is None for k in range(-lag, lag + 1))
            continue
        zx, zy = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        for k in range(-lag, lag + 1):
            want = sum(zx[i] * zy[i + k] for i in range(len(x)) if 0 <= i + k < len(x)) / len(x)
            assert got[a, b, k].r == pytest.approx(want, abs=1e-9)
    # the same scores as from one block, whatever the blocks
    whole = {(r.source, r.target): r for r in L.trigger_scores(df, "ts", pairs, s, E.seams(df, "ts", pairs, lag)).collect()}
    assert ("a", "b") in found and set(found) == set(whole) and ("still", "a") not in found
    for k, r in found.items():
        assert (r.jumps, r.n) == (whole[k].jumps, whole[k].n) and r.response == pytest.approx(whole[k].response) and r.baseline == pytest.approx(whole[k].baseline)


def test_lagged_relations_send_no_row_for_each_pair(spark, monkeypatch):
    """More pairs, the same rows: what is grouped by blocks has as many rows as the matrix."""
    df = sparse(spark)
    names = ["a", "b", "rare", "c", "still"]
    made = []
    real = S.seams
    monkeypatch.setattr(S, "seams", lambda *args: made.append(real(*args)) or made[-1])
    assert S.lagged(df, "ts", names, DiscoverySettings(max_lag=5, xcorr_min=0.0)).count() > 0
    assert len(made) == 1 and len(made[0].pairs) == 10 and made[0].blocks.count() == 400


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(float(i // 3), float(i * i % 7), float(i * 5 % 11)) for i in range(60)] + [(None, 1.0, 2.0), (None, 0.0, 3.0)], "ts double, a double, b double")
    got = [sorted((r.lag, round(r.r, 9)) for r in S.cross_correlations(df.repartition(k), "ts", [("a", "b")], 4, E.seams(df.repartition(k), "ts", [("a", "b")], 4, m)).collect()) for k, m in ((1, 7), (4, 1 << 16))]
    assert got[0] == got[1] and len(got[0]) == 9
    assert S.cross_correlations(df.limit(0), "ts", [("a", "b")], 4).count() == 0


def test_granger_sends_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(L, "series_pairs", None)
    assert {(r.source, r.target) for r in L.granger_tests(sparse(spark), "ts", [("a", "b"), ("a", "still")], 4, rows=25).collect()} == {("a", "b"), ("b", "a")}
