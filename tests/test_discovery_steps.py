"""Steps of discovery that look at the rows once for all pairs, targets or transitions."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from strandline.operators import clusters
from strandline.operators import stats as S
from strandline.operators import theory as T


def test_ranks_of_pairs_with_nulls(spark, monkeypatch):
    rng = np.random.default_rng(8)
    f = pd.DataFrame(rng.normal(size=(300, 4)).round(1), columns=["a", "b", "c", "odd|name"])
    f["b"] += f["a"]
    f = f.mask(rng.random(f.shape) < 0.1)
    f["a"] = f["a"].fillna(0.0)
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), "a double, b double, c double, `odd|name` double")
    # one look for all pairs, not one a pair
    monkeypatch.setattr(S, "ranked", None)
    got = {(r.a, r.b): r for r in S.spearman(df, list(f)).collect()}
    for a, b in combinations(f, 2):
        both = f[[a, b]].dropna().rank()
        assert got[a, b].n == len(both) and got[a, b].rho == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-9)


def test_all_triggers_at_once(spark):
    rng = np.random.default_rng(9)
    rows = [(float(i), round(float(rng.normal()), 1), None if i % 7 == 0 else float(i % 5), "ABC"[int(m)]) for i, m in enumerate(np.repeat(rng.integers(0, 3, 60), 4))]
    df = spark.createDataFrame(rows, "ts double, u double, w double, mode string")
    steps = T.next_modes(df.drop("mode"), df.select("ts", "mode"), "ts")
    moves = [(a, b) for a in "ABC" for b in "ABCZ" if a != b]
    got = T.trigger_rules(steps, ["u", "w"], moves)
    assert got == {m: T.trigger_rule(steps, None, "ts", ["u", "w"], *m) for m in moves}
    assert got["A", "Z"] == "N/A" and any(v != "N/A" for v in got.values())


def test_starts_that_settle_alike_are_scanned_once(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.1, size=(50, 2)) for c in (0, 5, 10)])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "z array<double>")
    seen, scan = [], clusters._scan
    monkeypatch.setattr(clusters, "_scan", lambda r, f, models: seen.append(len(models)) or scan(r, f, models))
    got = clusters.kmeans(rows, "z", [2, 3], x, 10, 1)
    assert max(seen) < 20
    assert np.allclose(sorted(got[3].tolist()), sorted(x.reshape(3, 50, 2).mean(1).tolist()))
