"""Registry, store and pipeline objects, exports and graph access, and what theory takes from data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import knowledge as K
from strandline.operators import ordered as O
from strandline.operators import sinks
from strandline.operators import theory as T
from strandline.operators.store import ObservationStore, Pipeline, VariableRegistry, register_exporter
from strandline.schema import ExportSettings, IngestSettings, TheorySettings


def test_registry():
    r = VariableRegistry()
    a = r.register("a", "INTEGER", "V", metadata={"x": 1})
    assert (a.id, r.get_or_create("a").id, r.get_or_create("b").dtype, len(r)) == (1, 1, "FLOAT", 2)
    with pytest.raises(ValueError):
        r.register("a", "FLOAT")
    assert r.get_by_id(2).name == "b" and r.get_by_name("zz") is None and "a" in r and 2 in r and 9 not in r
    assert [v.name for v in VariableRegistry.from_dict(r.to_dict())] == ["a", "b"]
    assert VariableRegistry.from_dict(r.to_dict()).register("c", "STRING").id == 3


def test_store(spark, tmp_path):
    s = ObservationStore(spark, batch_size=3)
    assert s.to_df().count() == 0 and len(s) == 0
    s.append_batch([(1.0, 1, True), (2.0, 1, 7), (3.0, 2, 1.5), (4.0, 2, "x"), (5.0, 1, None)])
    assert len(s) == 5 and [s.get_value_at(i) for i in range(5)] == [True, 7, 1.5, "x", None]
    with pytest.raises(IndexError):
        s.get_value_at(9)
    assert [t.num_rows for t in s.iter_batches()] == [3, 2]
    s.save_parquet(str(tmp_path / "o.parquet"))
    back = ObservationStore.load_parquet(spark, str(tmp_path / "o.parquet"))
    assert len(back) == 5 and back.get_value_at(3) == "x"
    reg = VariableRegistry()
    reg.register("u", "FLOAT"), reg.register("v", "FLOAT")
    m = sinks.state_matrix(sinks.load_observations(spark, str(tmp_path / "o.parquet")), reg.to_df(spark)).orderBy("timestamp").collect()
    assert [(r.timestamp, r.u, r.v) for r in m] == [(1.0, 1.0, None), (2.0, 7.0, None), (3.0, 7.0, 1.5), (4.0, 7.0, None), (5.0, None, None)]
    s.clear()
    assert len(s) == 0


def test_pipeline_and_exports(spark, tmp_path):
    p = Pipeline(spark, IngestSettings(missing_strategy="default", default_missing_value=0.0))
    p.ingest(["t=1,a=5", "t=2,a=6"], "kv")
    p.ingest(["t=2,b=7.5 V", "t=3,a=9.5"], "kv")
    obs, reg = p.observations()
    assert [(r.name, r.dtype) for r in reg.orderBy("id").collect()] == [("a", "FLOAT"), ("b", "FLOAT")]
    p.export("state_matrix", str(tmp_path / "m"))
    got = sorted((float(r.timestamp), float(r.a), float(r.b)) for r in spark.read.csv(str(tmp_path / "m"), header=True).collect())
    assert got == [(1.0, 5.0, 0.0), (2.0, 6.0, 7.5), (3.0, 9.5, 7.5)]
    p.export("sparse", str(tmp_path / "s.parquet"), ExportSettings(variables=[1], time_range=(2, 3)))
    assert spark.read.parquet(str(tmp_path / "s.parquet")).count() == 2
    p.export("observation", str(tmp_path / "o"), ExportSettings(format="parquet"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
    with pytest.raises(ValueError):
        p.export("xml", str(tmp_path / "x"))
    register_exporter("counts", lambda obs, reg, s: obs.groupBy("variable_id").count())
    p.export("counts", str(tmp_path / "c.parquet"))
    assert spark.read.parquet(str(tmp_path / "c.parquet")).count() == 2


def test_graph_access():
    g = K.graph(["a", "b"], [], [], [], {"a": {"unit": "V"}})
    K.add_edge(g, {"source": "a", "target": "b"})
    K.add_node(g, {"id": "b", "type": "mode"})
    assert K.edges_from(g, "a") == K.edges_to(g, "b") == [{"source": "a", "target": "b"}] and K.edges_to(g, "a") == []
    assert [n["type"] for n in g["nodes"]] == ["variable", "mode"] and g["nodes"][0]["metadata"] == {"unit": "V"}


def test_distances():
    s = TheorySettings()
    d = T.distances(["a", "b", "c"], [{"a": "a", "b": "b", "r": -0.43}, {"a": "a", "b": "c", "r": None}, {"a": "b", "b": "c", "r": 0.1}])
    assert d[0, 1] == pytest.approx(0.57) and d[0, 2] == 1 and d[1, 2] == pytest.approx(0.9)
    assert [x["variables"] for x in T.subsystems(["a", "b", "c"], d, s)] == [["a", "b"], ["c"]]
    f = [{"a": "a", "b": "b", "metric": "pearson", "value": 0.9}, {"a": "a", "b": "b", "metric": "spearman", "value": 0.6}, {"a": "a", "b": "c", "metric": "mutual_information", "value": 1.0}]
    d = T.distances(["a", "b", "c"], None, f, [{"source": "b", "target": "a", "confidence": 0.5}, {"source": "c", "target": "a", "confidence": 0.8}])
    assert d[0, 1] == pytest.approx(0.4) and d[0, 2] == pytest.approx(0.2)
    assert T.subsystems(["motor_speed", "rpm"], np.zeros((2, 2)), s)[0]["name"] == "Actuation Subsystem"


def test_trigger_by_means(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 9.0, 5.0)], "y int, a double, b double")
    assert T.by_means(df, ["b", "a"]) == "a > 5.5"
    labels = spark.createDataFrame([(float(i), m) for i, m in enumerate(["A", "A", "A", "B"])], "ts double, mode string")
    flat = labels.select("ts", F.lit(1.0).alias("x"))
    assert T.trigger_rule(flat, labels, "ts", ["x"], "A", "B") == "x <= 1"
    assert T.trigger_rule(flat, labels, "ts", ["x"], "B", "A") == "N/A"


def test_ordered(spark):
    rng = np.random.default_rng(7)
    x = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(float(v), v % 3) for v in x], "t double, k int").repartition(5)
    assert all(r._row == r.t for r in O.numbered(df, "t").collect())
    got = {(r.k, r.t): (r.a, r.b) for r in O.shifted(df, "t", {"a": ("t", 3), "b": ("t", -2)}, keys=["k"]).collect()}
    assert all(got[v % 3, float(v)] == (v - 9 if v >= 9 else None, v + 6 if v + 6 < 5000 else None) for v in x)
    split = O.blocks(O.numbered(df, "t"), back=4, ahead=2, size=100)
    assert split.filter("_own").count() == 5000 and split.filter("_block = 3").count() == 106


def test_stream_and_command_line(spark, tmp_path):
    from strandline import cli
    from strandline.streaming import ingest

    (tmp_path / "in").mkdir()
    rows = [(f"2026-01-01 00:{m:02d}:00", "a", float(m)) for m in range(50)]
    spark.createDataFrame(rows, "t string, variable string, value double").select(F.col("t").cast("timestamp").alias("ts"), "variable", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, variable string, value double").parquet(str(tmp_path / "in"))
    q = ingest.into_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    still = ingest.summaries(spark.read.parquet(str(tmp_path / "in")), width="30 minutes").orderBy("start").collect()
    assert [(r.n, r.low, r.high, r["last"]) for r in still] == [(30, 0.0, 29.0, 29.0), (20, 30.0, 49.0, 49.0)]
    (tmp_path / "a.csv").write_text("time,x,y\n" + "".join(f"{i},{i % 7},{i % 5}\n" for i in range(40)))
    assert cli.main([]) == 2
    assert cli.main(["ingest", "--input", str(tmp_path / "a.csv"), "--output-dir", str(tmp_path / "o"), "--batch-size", "15"]) == 0
    assert spark.read.csv(str(tmp_path / "o" / "aligned_state_matrix.csv"), header=True).count() == 40
    parts = [len(f.read_text().splitlines()) - 1 for f in (tmp_path / "o" / "canonical_triples.csv").glob("part-*")]
    assert sum(parts) == 80 and max(parts) <= 15 and (tmp_path / "o" / "sparse_coordinates.csv").is_dir()
