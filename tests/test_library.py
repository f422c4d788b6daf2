"""Semantics of the library on small tables made here."""

import json
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from strandline.functions import normalize as N
from strandline.functions.tails import f_upper, pearson_p, t_two_sided
from strandline.operators import align as A
from strandline.operators import dependence as D
from strandline.operators import knowledge as K
from strandline.operators import registry as R
from strandline.operators import sinks
from strandline.operators import stats as S
from strandline.operators import theory as T
from strandline.operators.twin import DigitalTwin, holds
from strandline.plans import catalog as C
from strandline.schema import DiscoverySettings, IngestSettings, TheorySettings
from strandline.sources import readers


def column(spark, values, c, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(c(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_types_and_units(spark):
    assert column(spark, ["1", "0", "yes", "2", "2.5", "x", "", "2026-01-02 03:04:05"], N.infer_type) == ["BOOLEAN", "BOOLEAN", "BOOLEAN", "INTEGER", "FLOAT", "STRING", "STRING", "TIMESTAMP"]
    assert column(spark, ["30.5 C", "4.18V", "1e5", "1.3e-2 kPa", "abc", "-5 deg"], N.unit_part) == ["C", "V", None, "kPa", None, "deg"]
    assert column(spark, ["30.5 C", "4.18V", "1e5", "abc"], N.value_part) == ["30.5", "4.18", "1e5", "abc"]
    assert column(spark, ["C", "rpm", "zork"], N.canonical_unit) == ["degree_Celsius", "revolutions_per_minute", "zork"]


def test_timestamps(spark):
    got = column(spark, ["12.5", "1970-01-01 00:01:00", "1970-01-02T00:00:00Z", "1970/01/02", "nonsense", None], N.timestamp)
    assert got == [12.5, 60.0, 86400.0, 86400.0, None, 0.0]
    assert column(spark, ["Jan 2 1970"], N.lenient_timestamp) == [86400.0]


def test_fold(spark):
    rows = [(1, "a", "1", None), (2, "a", "2", None), (3, "b", "1", None), (4, "b", "7", None), (5, "c", "3", None), (6, "c", "3.5", None), (7, "c", "x", None), (8, "d", "500 mV", None), (9, "d", "1 V", None)]
    raw = spark.createDataFrame([(s, str(s), n, v, "t", u) for s, n, v, u in rows], "seq bigint, timestamp_raw string, variable_name string, value_raw string, source string, unit_raw string")
    got = [(r.seq, r.dtype) for r in R.fold(raw).orderBy("seq").collect()]
    assert got == [(1, "BOOLEAN"), (2, "BOOLEAN"), (3, "BOOLEAN"), (4, "BOOLEAN"), (5, "INTEGER"), (6, "FLOAT"), (7, "STRING"), (8, "FLOAT"), (9, "FLOAT")]
    obs, reg = R.observations(raw)
    assert [(r.id, r.name, r.unit) for r in reg.orderBy("id").collect()] == [(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", "millivolt")]
    assert obs.filter("seq = 9").first().value_float == pytest.approx(1000)
    obs, reg = R.observations(raw, IngestSettings(unit_overrides={"d": "V"}))
    assert obs.filter("seq = 8").first().value_float == pytest.approx(0.5)
    assert R.observations(raw.withColumn("timestamp_raw", F.lit("nonsense")))[0].count() == 0


def brute(obs, strategy, t):
    obs = sorted(obs, key=lambda o: (o[0], o[2]))
    before = [o for o in obs if o[0] < t]
    upto = [o for o in obs if o[0] <= t]
    here = [o for o in obs if o[0] == t]
    after = [o for o in obs if o[0] >= t]
    if strategy == "exact":
        return here[0][1] if here else None
    if strategy == "forward_fill":
        return upto[-1][1] if upto else None
    if strategy == "nearest":
        if not before or not after:
            return after[0][1] if not before else before[-1][1]
        return before[-1][1] if t - before[-1][0] <= after[0][0] - t else after[0][1]
    if here:
        return here[0][1]
    if not before:
        return None
    if not after or before[-1][1] is None or after[0][1] is None:
        return before[-1][1]
    (a, x, _), (b, y, _) = before[-1], after[0]
    return x + (y - x) * (t - a) / (b - a)


@pytest.mark.parametrize("strategy", ["exact", "nearest", "forward_fill", "interpolate"])
def test_align(spark, strategy):
    rows = [(1.0, "a", 1.0, 1), (1.0, "a", 2.0, 2), (3.0, "a", None, 3), (5.0, "a", 7.0, 4), (9.0, "a", 1.0, 5), (2.0, "b", 4.0, 6), (6.0, "b", 8.0, 7)]
    obs = spark.createDataFrame(rows, "ts double, variable string, value double, seq bigint")
    targets = spark.createDataFrame([(float(t),) for t in range(0, 12)], "ts double")
    got = {(r.ts, r.variable): r.value for r in A.align(obs, strategy, targets).collect()}
    for t in range(0, 12):
        for v in "ab":
            assert got[float(t), v] == brute([(r[0], r[2], r[3]) for r in rows if r[1] == v], strategy, float(t)), (t, v)


def test_fill(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (4.0, None), (5.0, 4.0), (6.0, None)], "ts double, v double")
    get = lambda d: [r.v for r in d.orderBy("ts").collect()]
    assert get(A.fill(df, ["v"], "forward_fill")) == [None, 1.0, 1.0, 4.0, 4.0]
    assert get(A.fill(df, ["v"], "interpolate")) == [None, 1.0, 3.0, 4.0, None]
    assert get(A.fill(df, ["v"], "interpolate", by_index=True)) == [None, 1.0, 2.5, 4.0, None]
    assert get(A.fill(df, ["v"], "default", 9.0)) == [9.0, 1.0, 9.0, 4.0, 9.0]


def test_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803477074037, rel=1e-9)
    assert f_upper(4.0, 2, 10) == pytest.approx((1 + 0.2 * 4) ** -5, rel=1e-9)
    assert pearson_p(1.0, 20) == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,temp,state\n1,30.5 C,on\n2,"31 C",\n')
    got = [(r.timestamp_raw, r.variable_name, r.value_raw) for r in readers.read(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()]
    assert got == [("1", "temp", "30.5 C"), ("1", "state", "on"), ("2", "temp", "31 C")]
    (tmp_path / "b.jsonl").write_text('{"ts": 1, "s": {"x": 1.5, "ok": true}}\nbad\n{"ts": 2, "s": {"x": 2.5}}\n')
    got = [(r.timestamp_raw, r.variable_name, r.value_raw) for r in readers.read(spark, str(tmp_path / "b.jsonl")).collect()]
    assert sorted(got) == [("1", "s.ok", "True"), ("1", "s.x", "1.5"), ("2", "s.x", "2.5")]
    (tmp_path / "c.kv").write_text('time=5, a=1, b="x, y", a=2\n')
    assert {(r.timestamp_raw, r.variable_name, r.value_raw) for r in readers.read(spark, str(tmp_path / "c.kv")).collect()} == {("5", "b", "x, y"), ("5", "a", "2")}
    (tmp_path / "d.txt").write_text("2026-01-02T03:04:05Z Motor speed changed to 500 RPM\n7 odd line\n2026-01-02 03:04:05\n")
    got = {(r.variable_name, r.value_raw, r.unit_raw) for r in readers.read(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {("Motor_speed", "500", "RPM"), ("log_line", "odd line", None), ("event", "ping", None)}
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "a.csv"), "xml")
    assert readers.sniff('{"a": 1}') == "json" and readers.sniff("a=1,b=2") == "kv" and readers.sniff("a,b\n1,2") == "csv" and readers.sniff("hm") is None


def test_planted_structure(spark):
    rng = np.random.default_rng(1)
    n = 400
    a = rng.normal(size=n)
    b = np.concatenate([np.zeros(7), 2 * a[:-7]]) + 0.05 * rng.normal(size=n)
    df = spark.createDataFrame([(float(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "ts double, a double, b double")
    r = [x for x in S.lagged(df, "ts", ["a", "b"]).collect() if x.type == "INFLUENCES"]
    assert [(x.source, x.target, x.lag) for x in r] == [("a", "b", 7.0)]
    g = S.causes(df, "ts", [("a", "b")]).filter("source = 'a'").first()
    assert g.target == "b" and g.p < 1e-6
    fit = T.equations(df, "ts", {("a", "b"): {"confidence": 0.9, "lag": 7.0, "sign": 1}}, [], TheorySettings())[0]
    assert fit["coef"][0] == pytest.approx(2, abs=0.05) and fit["r2"] > 0.9


def test_rules_modes_and_theory(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = np.repeat([[0, 0], [10, 0], [0, 10]], 34, axis=0)
    x = np.tile(centre, (3, 1)) + 0.3 * rng.normal(size=(306, 2))
    df = spark.createDataFrame([(float(i), float(p), float(q)) for i, (p, q) in enumerate(x)], "ts double, temp double, load double")
    m = K.discover(df, "ts", DiscoverySettings())
    assert len(m.modes) == 3 and sum(t["n"] for t in m.transitions) == 8
    assert all(r["precision"] >= 0.6 for r in m.rules) and m.rules
    t = T.synthesize(m, df)
    assert any(x["trigger"] != "N/A" for x in t.transitions) or t.transitions
    sinks.model_files(m, str(tmp_path))
    back = sinks.load_model(str(tmp_path))
    assert back.variables == m.variables and len(back.modes) == 3
    sinks.theory_files(t, str(tmp_path))
    json.loads((tmp_path / "theory.json").read_text())
    assert subprocess.run([sys.executable, str(tmp_path / "twin.py")], capture_output=True).returncode == 0


def test_degenerate(spark):
    df = spark.createDataFrame([(float(i), 1.0, None, "x") for i in range(30)], "ts double, c double, n double, s string")
    m = K.discover(df, "ts")
    assert not m.findings and not m.relations and not m.rules
    assert K.discover(df.limit(0), "ts").modes == []


def test_graph_operators():
    e = {("a", "b"): {"confidence": 0.9, "lag": 1.0, "sign": 1}, ("b", "c"): {"confidence": 0.8, "lag": 2.0, "sign": -1}, ("c", "d"): {"confidence": 0.7, "lag": 0.0, "sign": 1}, ("c", "b"): {"confidence": 0.6, "lag": 0.0, "sign": 1}}
    assert T.chains(e)[0]["path"] == ["a", "b", "c", "d"] and T.chains(e)[0]["confidence"] == 0.7
    assert [(x["path"], x["polarity"]) for x in T.loops(e)] == [(["b", "c"], "negative")]
    assert T.aliases(["temp", "temperature"], [{"a": "temp", "b": "temperature", "metric": "pearson", "value": 0.99}]) == {"temperature": "temp"}
    assert T.complete_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]]), 0.75, 5) == [[0, 1], [2]]


def test_twin():
    twin = DigitalTwin(["u", "y"], [{"target": "y", "sources": ["u"], "lags": [1], "kind": "linear", "intercept": 0.0, "coef": [2.0]}], [{"name": "Idle", "prevalence": 0.6, "centroid": {"u": 0.0}}, {"name": "Busy", "prevalence": 0.4, "centroid": {}}], [{"from_state": "Idle", "to_state": "Busy", "trigger": "y > 3", "probability": 1.0}])
    twin.step({"u": 2.0})
    assert twin.step({"u": 5.0})["y"] == 4.0 and twin.mode == "Busy"
    assert holds("y >= 2", {"y": 2.0}) and not holds("nonsense", {}) and not holds("z > 1", {"y": 2})


def test_information():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    r = 0.8
    y = r * x + math.sqrt(1 - r * r) * rng.normal(size=600)
    assert plain.mutual_information(x, y) == pytest.approx(-0.5 * math.log(1 - r * r), abs=0.12)
    assert plain.mutual_information(x, np.ones(600)) == 0.0


def test_entry_without_llm(tmp_path):
    """A copy of the repository without the corpus operators still has the library's queries, and says nothing of others."""
    root = Path(C.__file__).resolve().parents[2]
    shutil.copytree(root / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    names, sql = json.loads(got.stdout)
    assert names == sorted(C.QUERIES) and sql == sorted(C.SQL) and set(sql) <= set(names) and len(names) > 50


def test_kth_distance():
    rng = np.random.default_rng(3)
    for n in (5, 65, 900):
        for x in (rng.normal(size=n), np.repeat(rng.normal(size=n), 4)[:n], np.round(rng.normal(size=n))):
            y = 0.8 * x + rng.normal(size=n)
            d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
            assert np.array_equal(D.kth_distance(x, y, 3), np.sort(d, axis=1)[:, 3])


def test_kernel_queries_take_every_time(spark, tmp_path, monkeypatch):
    """The queries of the kernels see each observed time, not hourly means, and lags as far as the operators' default."""
    rng = np.random.default_rng(4)
    v = rng.normal(50, 10, size=700)
    rows = [(i, float(i), name, float(v[max(i // 5 - 6 * (name == "view"), 0)] if name in ("click", "view") else rng.normal(50, 10))) for i in range(3500) for name in [C.TYPES[i % 5]]]
    spark.createDataFrame(rows, "event_id bigint, at double, event_type string, value double").select("event_id", F.col("at").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    m = C.event_matrix(spark, str(tmp_path))[0].toPandas().sort_values("ts").astype(float)
    assert len(m) == 3500
    got = lambda name: C.QUERIES[name](spark, str(tmp_path)).collect()
    pair = m[["click", "view"]].dropna()
    want = plain.mutual_information(pair.click.to_numpy(), pair.view.to_numpy())
    assert next(r.mi for r in got("mutual_information") if (r.a, r.b) == ("click", "view")) == pytest.approx(want, abs=0.02)
    lag = next(r for r in got("lagged_relations") if r.type == "INFLUENCES" and {r.source, r.target} == {"click", "view"})
    assert (lag.source, lag.target) == ("click", "view") and 25 < lag.lag <= 40
    assert next(r for r in got("granger_pairs") if (r.source, r.target) == ("click", "error")).p == pytest.approx(plain.granger(*m[["click", "error"]].dropna().to_numpy().T, 10)[0], rel=1e-6)
    rules = got("threshold_rules")
    assert sorted(map(str, rules)) == sorted(map(str, K.rules(C.event_matrix(spark, str(tmp_path))[0], C.TYPES).collect())) and rules
    seen = []
    monkeypatch.setattr(K, "modes", lambda df, *_: seen.append(df.count()) or K.Modes())
    monkeypatch.setattr(K, "discover", lambda df, *_: seen.append(df.count()) or K.SystemModel(C.TYPES, 0))
    monkeypatch.setattr(T, "synthesize", lambda *_: SimpleNamespace(subsystems=[], equations=[]))
    got("operating_modes"), got("discovered_model")
    assert seen == [3500, 3500]
