"""Kernels by ranges and blocks against the plain ones over whole series, with blocks and ranges far smaller than the series."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from strandline.operators import clusters as C
from strandline.operators import dependence as D
from strandline.operators import knowledge as K
from strandline.operators import lags as L
from strandline.operators import ordered, trees
from strandline.operators import stats as S
from strandline.schema import DiscoverySettings


def series(spark, n=700, gaps=True):
    rng = np.random.default_rng(8)
    a = np.cumsum(rng.normal(size=n)) * 0.2 + rng.normal(size=n)
    b = np.concatenate([np.zeros(7), 2 * a[:-7]]) + 0.3 * rng.normal(size=n)
    c = np.round(rng.normal(size=n), 1)
    rows = [(float(i), *(None if gaps and (i * k) % 97 == 5 else float(v[i]) for k, v in ((1, a), (3, b), (5, c))), 4.0) for i in range(n)]
    df = spark.createDataFrame(rows, "ts double, a double, b double, `odd|name` double, still double").repartition(5)
    return df.cache(), ["a", "b", "odd|name", "still"]


def pair(df, a, b):
    p = df.orderBy("ts").select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).dropna().toPandas()
    return p.x.to_numpy(), p.y.to_numpy()


def test_granger_from_sums_of_blocks(spark):
    df, names = series(spark)
    pairs = [("a", "b"), ("odd|name", "a"), ("a", "still")]
    for rows in (1 << 16, 50):
        got = {(r.source, r.target): (r.p, r.lag) for r in L.granger_tests(df, "ts", pairs, 6, rows=rows).collect()}
        assert set(got) == {("a", "b"), ("b", "a"), ("odd|name", "a"), ("a", "odd|name")}
        for (s, t), (p, lag) in got.items():
            want = plain.granger(*pair(df, s, t), 6)
            assert lag == want[1] and p == pytest.approx(want[0], rel=1e-8, abs=1e-12)
    short = df.filter("ts < 31")
    assert {r.lag <= 5 for r in L.granger_tests(short, "ts", [("a", "b")], 10, least=20).collect()} == {True}
    assert L.granger_tests(df.limit(0), "ts", pairs, 6).count() == 0


def plain_scores(x, y, s):
    dx, dy = np.diff(x), np.abs(np.diff(y))
    m, lag = len(dx), min(s.max_lag, len(x) // 4)
    jumps = np.flatnonzero(np.abs(dx) / (dx.std() + 1e-10) > s.jump_z)
    mean = lambda i: dy[i : i + lag].mean() if i < m else None
    response = [mean(i + 1) for i in jumps if mean(i + 1) is not None]
    starts = [((3 * int(i) + r + 1) * 2654435761 + s.seed) % (1 << 32) * (m - lag) >> 32 for i in jumps for r in range(3)]
    return len(jumps), np.mean(response), np.mean([mean(i) for i in starts])


def test_triggers_from_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ordered.blocks, "__defaults__", ("_row", 0, 0, 40))
    df, names = series(spark)
    s = DiscoverySettings(max_lag=9, jump_z=2.0)
    got = {(r.source, r.target): r for r in L.trigger_scores(df, "ts", [("a", "b"), ("odd|name", "b"), ("a", "still")], s).collect()}
    assert {("a", "b"), ("b", "a"), ("a", "still")} <= set(got) and ("still", "a") not in got
    for (a, b), r in got.items():
        jumps, response, baseline = plain_scores(*pair(df, a, b), s)
        assert r.jumps == jumps and r.response == pytest.approx(response) and r.baseline == pytest.approx(baseline, abs=1e-12)
        assert r.ratio == pytest.approx(response / (baseline + 1e-10)) and 0 <= r.confidence <= 0.85
    assert L.trigger_scores(df.limit(0), "ts", [("a", "b")], s).count() == 0


def test_neighbours_over_ranges(spark):
    df, names = series(spark)
    pairs = [("a", "b"), ("a", "odd|name"), ("b", "still")]
    want = {p: plain.mutual_information(*pair(df, *p)) for p in pairs}
    for rows in (1 << 16, 60):
        got = {(r.a, r.b): r for r in D.mutual_informations(df, "ts", pairs, rows=rows).collect()}
        for p in pairs:
            # ties are broken by another noise
            assert got[p].mi == pytest.approx(want[p], abs=1e-9 if p == ("a", "b") else 0.02)
        assert got["b", "still"].mi == 0.0 and got["a", "b"].n == len(pair(df, "a", "b")[0])
    one = D.mutual_informations(df, "ts", pairs[:2], rows=60).collect()
    many = D.mutual_informations(df, "ts", pairs[:2], rows=1 << 16).collect()
    assert sorted(r.mi for r in one) == pytest.approx(sorted(r.mi for r in many), abs=1e-12)
    assert [r.mi for r in D.mutual_informations(df.limit(3), "ts", [("a", "b")]).collect()] == [0.0]


def test_trees_from_counts(spark):
    df, names = series(spark)
    full = df.select(*names).dropna().toPandas()
    for depth, least in ((1, 10), (3, 10), (3, 60)):
        grown, rows = trees.grow(df.select(*names).dropna(), names, depth, [least, least, least, len(full)])
        leaves = rows.select(F.inline(F.transform("nodes", lambda n, i: F.struct(i.alias("t"), n.alias("node"))))).groupBy("t", "node").count().collect()
        for t, target in enumerate(names[:3]):
            others = [j for j in range(len(names)) if j != t]
            want = plain.tree_leaves(full.iloc[:, others].to_numpy(), full[target].to_numpy(), depth, least)
            want = [([(others[j], op, th) for j, op, th in path], len(i)) for path, i in want]
            got = [(trees.path(grown[t], r.node), r["count"]) for r in leaves if r.t == t]
            shape = lambda xs: sorted(([(j, op, round(th, 9)) for j, op, th in p], n) for p, n in xs)
            assert shape(got) == shape(want)
        assert [r for r in leaves if r.t == 3] == [r for r in leaves if r.t == 3 and r.node == 1]


def test_rules_need_rows_and_variance(spark):
    df, names = series(spark)
    assert K.rules(df.limit(20), names).count() == 0 and K.rules(df, ["a"]).count() == 0
    found = K.rules(df, names).collect()
    assert found and all(r.target != "still" for r in found)


def test_helpers_of_any_name(spark):
    df = spark.createDataFrame([(float(i), i % 2, i, i * 10, float(i)) for i in range(20)], "ts double, _k0 int, _block int, _own int, v double")
    out = ordered.shifted(df, "ts", {"back": ("_own", 1), "ahead": ("v", -1)}, keys=["_k0"]).orderBy("ts").collect()
    assert [(r.back, r.ahead) for r in out[2:4]] == [(0, 4.0), (10, 5.0)] and out[5]._block == 5
    by = ordered.nearest(df, "ts", {"last": F.col("v")}, {}, ["_k0", "_block"])
    assert by.count() == 20 and all(r["last"] == r.v for r in by.collect())
    assert ordered.numbered(df, "ts", keys=["_k0"], name="place").agg(F.max("place")).first()[0] == 9


def test_many_columns_in_one_scan(spark):
    """Sums of products against a plain correlation of each pair's complete rows, and against the few pairs' aggregates."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 25)) @ rng.normal(size=(25, 25)) + 1e4
    x[:, 3] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = np.nan
    names = [f"odd name {i}" for i in range(25)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(6)
    got = {(r.a, r.b): r for r in S.pair_moments(df, names).collect()}
    assert len(got) == 300
    for i in range(25):
        for j in range(i + 1, 25):
            r = got[names[i], names[j]]
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert (r.rows, r.n) == (300, ok.sum())
            if 3 in (i, j) or 4 in (i, j):
                assert r.r is None
            else:
                assert r.r == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)
    few = {(r.a, r.b): r.r for r in S.pair_moments(df, names[:4]).collect()}
    assert {p: r and round(r, 8) for p, r in few.items()} == {p: got[p].r and round(got[p].r, 8) for p in few}
    assert S.pair_moments(df, names[:1]).count() == 0 and S.gram_moments(df.limit(0), names).count() in (0, 300)


def test_clusters_of_many_starts(spark):
    """Planted groups are found from ten starts in shared scans; silhouettes of all rows are the plain ones."""
    rng = np.random.default_rng(5)
    centre = np.array([[0, 0], [6, 0], [0, 6], [6, 6], [3, 12]])
    x = np.repeat(centre, 60, axis=0) + 0.4 * rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(float(i), [float(v) for v in r]) for i, r in enumerate(x)], "ts double, z array<double>").repartition(4).cache()
    some = C.sample_of(rows, "ts", "z", 42)
    assert len(some) == 300
    fits = C.kmeans(rows, "z", [2, 5], np.stack(some.z.to_numpy()))
    assert sorted(fits) == [2, 5] and len(fits[5]) == 5
    assert np.allclose(sorted(map(tuple, fits[5])), sorted(tuple(x[i * 60 : i * 60 + 60].mean(0)) for i in range(5)), atol=1e-6)
    out = C.labelled(rows, "z", fits[5]).cache()
    labels = {r.ts: r.prediction for r in out.collect()}
    near = np.array([labels[t] for t in some.ts])
    got = C.silhouettes(out, "ts", "z", "prediction", some, near)
    _, each = K.silhouette(np.stack(some.z.to_numpy()), near)
    assert got == {k: pytest.approx(each[near == k].mean()) for k in range(5)}
    # against a part of the rows it is close
    part = some.head(100)
    assert all(abs(v - got[k]) < 0.1 for k, v in C.silhouettes(out, "ts", "z", "prediction", part, near[:100]).items())
    assert C.silhouettes(out, "ts", "z", "prediction", part, np.zeros(100, int)) == {}


def test_forward_matrix_has_no_row_for_each_cell(spark):
    """The matrix of forward fill straight from rows: the same as from cells, without a product of times and variables."""
    from strandline.operators import align as A
    from strandline.plans import catalog as C

    rows = [(1, 1.0, "a", 5.0), (2, 1.0, "a", None), (3, 2.0, "b", 1.0), (4, None, "a", 9.0), (5, 3.0, None, 2.0), (6, 4.0, "a", 7.0), (7, 4.0, "a", 6.0), (8, 5.0, "b", None), (9, 6.0, "c", 1.0), (10, 7.0, "a", 3.0)]
    obs = spark.createDataFrame(rows, "seq bigint, ts double, variable string, value double")
    want = A.matrix(A.align(obs, "forward_fill"), ["a", "b"])
    assert sorted(map(str, A.forward_matrix(obs, ["a", "b"]).collect())) == sorted(map(str, want.collect()))
    plan = C.event_matrix(spark, "/root/testdata/sf0.001")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_kth_distance_of_a_thin_range():
    """A range of x of a long series is thin: neighbours by x alone are mostly far away by y."""
    import time

    from strandline.operators.dependence import kth_distance

    rng = np.random.default_rng(1)
    x, y = np.repeat(np.round(rng.random(13108), 3), 5)[: 1 << 16] + 1e-9 * rng.random(1 << 16), 100 * rng.random(1 << 16)
    began = time.perf_counter()
    d = kth_distance(x, y, 3)
    assert time.perf_counter() - began < 4
    some = rng.integers(0, 1 << 16, 50)
    assert np.array_equal(d[some], [np.sort(np.maximum(np.abs(x - x[i]), np.abs(y - y[i])))[3] for i in some])
