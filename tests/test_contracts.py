"""Smaller contracts: settings, resolutions, signs, states, registry metadata, frames of pandas."""

import time

import numpy as np
import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F

from strandline.functions import normalize as N
from strandline.operators import knowledge as K
from strandline.operators import sinks
from strandline.operators import theory as T
from strandline.operators.store import Pipeline
from strandline.schema import IngestSettings, TheorySettings


def test_batch_size_is_a_setting(tmp_path):
    (tmp_path / "s.toml").write_text("[general]\nbatch_size = 500\n")
    assert IngestSettings.from_toml(str(tmp_path / "s.toml")).batch_size == 500
    assert IngestSettings().batch_size == 10_000
    with pytest.raises(ValueError):
        IngestSettings.from_dict({"general": {"batch_size": 0}})


def test_whole_numbers_are_truncated(spark):
    df = spark.createDataFrame([("-3.7",), ("3.7",), ("-3",), ("1e3",), ("x",)], "t string")
    got = [r.value_int for r in df.select(N.coerce(F.col("t"), F.lit("INTEGER"))["value_int"].alias("value_int")).collect()]
    assert got == [-3, 3, -3, 1000, None]


def test_resolutions_compare_both_sides():
    rule = {"target": "y", "conditions": [{"variable": "x", "operator": ">", "threshold": 1.0}], "confidence": 0.8}
    model = K.SystemModel(
        ["x", "y"], 10, findings=[{"a": "x", "b": "y", "metric": "pearson", "confidence": 0.6}], relations=[{"source": "x", "target": "y", "confidence": 0.6}, {"source": "y", "target": "x", "confidence": 0.9}], rules=[rule]
    )
    found = [
        {"kind": "rule_sign", "target": "y", "variable": "x", "metric": "pearson"},
        {"kind": "correlation_sign", "source": "x", "target": "y", "metric": "pearson"},
        {"kind": "bidirectional", "source": "x", "target": "y"},
        {"kind": "rule_sign", "target": "y", "variable": "z", "metric": "spearman"},
    ]
    got = [(r["resolution"], round(r["confidence_delta"], 9), r["primary_explanation"]) for r in T.resolve(found, model)]
    assert got == [("rule", 0.2, "rule of y by x"), ("finding", 0.0, "pearson of x and y"), ("reverse", 0.3, "y -> x"), ("finding", 0.0, "spearman of z and y")]
    assert "0.80 against 0.60" in T.resolve(found, model)[0]["rationale"]


def test_signs_from_descriptions():
    base = {"source": "a", "target": "b", "type": "INFLUENCES", "confidence": 0.9, "lag": 0.0}
    sign = lambda r, signs: T.edges_of([r], signs, TheorySettings())["a", "b"]["sign"]
    assert sign(base, {("a", "b"): 1}) == 1 and sign(base, {("a", "b"): -1}) == -1
    assert sign({**base, "description": "b tends to Decrease"}, {("a", "b"): 1}) == -1
    later = T.edges_of([base, {**base, "confidence": 0.5}], {}, TheorySettings())["a", "b"]
    assert later["confidence"] == 0.5


def test_states_have_descriptions():
    modes = [{"label": "m0", "prevalence": 0.5, "centroid": {"motor_speed": 0.0, "temp": 1.0}}, {"label": "m1", "prevalence": 0.3, "centroid": {"motor_speed": 9.0, "temp": 1.2}}, {"label": "m2", "prevalence": 0.2, "centroid": {"motor_speed": 5.0, "temp": 9.0}}]
    got = [(s["name"], s["description"]) for s in T.states(modes)]
    assert [n for n, _ in got] == ["Idle State", "High-Load Operational State", "Thermal Stress State"]
    assert got[0][1].endswith("low motor_speed, temp") and "high temp" in got[2][1]


def test_registry_metadata_reaches_graph_and_file(spark, tmp_path):
    reg = spark.createDataFrame([(1, "a", "FLOAT", "volt", "s.csv", {"site": "north"}), (2, "b", "FLOAT", None, None, None)], "id int, name string, dtype string, unit string, source string, metadata map<string,string>")
    sinks.save_registry(reg, str(tmp_path / "r.json"))
    back = sinks.load_registry(spark, str(tmp_path / "r.json"))
    assert back.orderBy("id").first().metadata == {"site": "north"}
    assert "metadata" not in sinks.load_registry(spark, str(tmp_path / "r.json")).drop("metadata").columns
    frame = pd.DataFrame({"a": np.arange(30.0), "b": np.arange(30.0) % 7, "word": ["x"] * 30}, index=pd.date_range("2026-01-01", periods=30, freq="s"))
    model = K.discover(frame, "ts", registry=back)
    nodes = {n["id"]: n.get("metadata") for n in model.graph["nodes"] if n["type"] == "variable"}
    assert nodes["a"] == {"id": 1, "dtype": "FLOAT", "unit": "volt", "source": "s.csv", "site": "north"} and model.rows == 30 and set(model.variables) == {"a", "b"}


def test_pipeline_hands_its_registry_over(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x,y\n" + "".join(f"{i},{i % 7} V,{i % 5}.5\n" for i in range(40)))
    p = Pipeline(spark)
    p.ingest(str(tmp_path / "a.csv"))
    about = {n["id"]: n.get("metadata", {}) for n in p.discover().graph["nodes"]}
    assert about["x"]["unit"] == "volt" and about["y"]["dtype"] == "FLOAT"


def test_chains_against_every_path():
    rng = np.random.default_rng(12)
    for case in range(60):
        n = int(rng.integers(2, 8))
        names = [f"v{i}" for i in range(n)]
        edges = {(a, b): {"confidence": float(rng.choice([0.4, 0.5, 0.9])), "lag": 1.0, "sign": int(rng.choice([1, -1]))} for a in names for b in names if a != b and rng.random() < 0.35}
        for most in (2, 12):
            assert [(c["path"], c["confidence"]) for c in T.chains(edges, most)] == plain.chains(edges, most), case
        # cycles are those of a search without components
        cycles = {tuple(c["path"]) for c in T.loops(edges)}
        want = set()
        todo = [[a] for a in names]
        while todo:
            p = todo.pop()
            if len(p) > 1 and (p[-1], p[0]) in edges:
                want.add(tuple(p))
            todo += [[*p, b] for b in names if (p[-1], b) in edges and b > p[0] and b not in p]
        assert cycles == want


def test_chains_of_a_full_graph_end():
    rng = np.random.default_rng(1)
    names = [f"v{i:03d}" for i in range(200)]
    edges = {(a, b): {"confidence": float(rng.random()), "lag": 0.5, "sign": 1} for a in names for b in names if a != b}
    began = time.time()
    got = T.chains(edges)
    assert time.time() - began < 10 and len(got) == 12 and all(len(c["path"]) == 5 for c in got)
    assert [c["confidence"] for c in got] == sorted((c["confidence"] for c in got), reverse=True) and got[0]["confidence"] > 0.99
    # a long way with one circle at its end
    line = {(f"n{i:04d}", f"n{i + 1:04d}"): {"confidence": 0.5, "lag": 0.0, "sign": 1} for i in range(3000)}
    line["n3000", "n2999"] = {"confidence": 0.7, "lag": 0.0, "sign": -1}
    assert [(c["path"], c["polarity"]) for c in T.loops(line)] == [(["n2999", "n3000"], "negative")]
