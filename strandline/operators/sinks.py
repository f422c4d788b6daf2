"""Sinks: observation tables, state matrices, models, reports and a stand-alone twin."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import align as A
from strandline.operators.knowledge import SystemModel, rule_text
from strandline.operators.registry import as_text, resolved
from strandline.operators.theory import Theory
from strandline.schema import OBSERVATIONS, QUALITY, ExportSettings


def selected(obs: DataFrame, variables: list[int] | None = None, time_range: tuple[float, float] | None = None) -> DataFrame:
    """Observations of some variables (none given: all) in an inclusive range of time; both reach the scan."""
    if variables:
        obs = obs.filter(F.col("variable_id").isin(*variables))
    return obs.filter(F.col("timestamp").between(*time_range)) if time_range else obs


def observation_table(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """The long form; a variable that the registry lacks is named var_<id>. Null values stay."""
    names = registry.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    quality = F.try_element_at(F.array(*[F.lit(q) for q in QUALITY]), F.col("quality").cast("int") + 1)
    return obs.join(names, F.col("variable_id") == F.col("_id"), "left").select("timestamp", "variable_id", F.coalesce("_name", F.concat(F.lit("var_"), F.col("variable_id").cast("string"))).alias("variable_name"), as_text().alias("value"), quality.alias("quality"), "original_timestamp", "source")


def sparse_table(obs: DataFrame) -> DataFrame:
    return obs.select("timestamp", "variable_id", as_text().alias("value")).filter("value IS NOT NULL")


def state_matrix(obs: DataFrame, registry: DataFrame, alignment: str = "forward_fill", missing: str = "leave", default: float | None = None, variables: list[int] | None = None, time_range: tuple[float, float] | None = None, numeric: bool = True) -> DataFrame:
    """One row a time of the range, one column a variable by id; values before the range still count for alignment."""
    reg = [r for r in registry.orderBy("id").collect() if not variables or r.id in variables]
    seen: dict[str, int] = {}
    names = {}
    for r in reg:
        names[r.id] = r.name if r.name not in seen else f"{r.name}_{r.id}"
        seen[r.name] = r.id
    value = resolved() if numeric else as_text()
    ids = list(names)
    long = obs.filter(F.col("variable_id").isin(*ids)).select(F.col("timestamp").alias("ts"), F.col("variable_id").alias("variable"), value.alias("value"), "seq")
    grid = obs.select(F.col("timestamp").alias("ts"))
    if time_range:
        grid = grid.filter(F.col("ts").between(*time_range))
    wide = A.matrix(A.align(long, alignment, targets=grid.distinct()), [str(i) for i in ids])
    wide = wide.select(F.col("ts").alias("timestamp"), *[F.col(str(i)).alias(names[i]) for i in ids])
    return A.fill(wide, list(names.values()), missing, default, "timestamp")


def write(df: DataFrame, path: str, format_name: str | None = None, most: int | None = None) -> None:
    """Parquet for a path that ends in .parquet or where asked for, else CSV with a header; null is empty. most: rows of a
    file."""
    out = df.write.mode("overwrite")
    out = out.option("maxRecordsPerFile", most) if most else out
    if path.endswith(".parquet") or format_name == "parquet":
        out.parquet(path)
    else:
        out.option("header", True).option("emptyValue", "").csv(path)


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations as they were saved. A table without `seq` gets one in order of its rows."""
    df = spark.read.parquet(path)
    df = df if "seq" in df.columns else spark.read.schema(OBSERVATIONS).parquet(path).withColumn("seq", F.monotonically_increasing_id())
    return df.select("seq", *[c for c in df.columns if c != "seq"])


#: Tables by mode of export, of observations, registry and settings.
EXPORTERS: dict[str, Callable[[DataFrame, DataFrame, ExportSettings], DataFrame]] = {
    "observation": lambda obs, reg, s: observation_table(selected(obs, s.variables, s.time_range), reg),
    "sparse": lambda obs, reg, s: sparse_table(selected(obs, s.variables, s.time_range)),
    "state_matrix": lambda obs, reg, s: state_matrix(obs, reg, s.alignment_strategy, s.missing_strategy, s.default_missing_value, s.variables, s.time_range),
}


def export(obs: DataFrame, registry: DataFrame, mode: str, path: str, settings: ExportSettings | None = None) -> None:
    """Writes a table by mode; an unknown mode is an error."""
    s = settings or ExportSettings()
    if mode not in EXPORTERS:
        raise ValueError(f"unknown mode {mode}")
    write(EXPORTERS[mode](obs, registry, s), path, s.format)


def plain(x):
    """x as JSON can hold it: numbers as Python's, NaN as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def save_registry(registry: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps([r.asDict(True) for r in registry.orderBy("id").collect()], indent=1))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A saved registry; with `metadata` (a map of texts) if any variable was saved with some."""
    rows = json.loads(Path(path).read_text())
    kind = "id int, name string, dtype string, unit string, source string"
    plain_ = [(r["id"], r["name"], r["dtype"], r["unit"], r["source"]) for r in rows]
    if not any(r.get("metadata") for r in rows):
        return spark.createDataFrame(plain_, kind)
    return spark.createDataFrame([(*x, {k: str(v) for k, v in (r.get("metadata") or {}).items()}) for x, r in zip(plain_, rows, strict=True)], f"{kind}, metadata map<string,string>")


def model_files(m: SystemModel, folder: str) -> None:
    """Graph, rules, relationships and a report of a system model."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "graph.json").write_text(json.dumps(plain(m.graph), indent=1))
    (out / "rules.json").write_text(json.dumps(plain({"rules": [{**r, "rule_text": rule_text(r)} for r in m.rules]}), indent=1))
    (out / "relationships.json").write_text(json.dumps(plain({"variables": m.variables, "rows": m.rows, "findings": m.findings, "relationships": m.relations, "modes": m.modes, "transitions": m.transitions, "contradictions": m.contradictions}), indent=1))
    (out / "report.md").write_text(model_report(m))


def load_model(folder: str) -> SystemModel:
    d = json.loads((Path(folder) / "relationships.json").read_text())
    rules = json.loads((Path(folder) / "rules.json").read_text())["rules"]
    return SystemModel(d["variables"], d["rows"], d["findings"], d["relationships"], rules, d["modes"], d["transitions"], d["contradictions"], json.loads((Path(folder) / "graph.json").read_text()))


def model_report(m: SystemModel, most: int = 50) -> str:
    lines = ["# System model", "", f"{len(m.variables)} variables over {m.rows} times.", "", "## Findings", ""]
    lines += [f"- {f['a']} / {f['b']}: {f['metric']} {f['value']:.3f} (confidence {f['confidence']:.2f})" for f in sorted(m.findings, key=lambda f: -f["confidence"])[:most]] or ["None."]
    lines += ["", "## Relationships", "", *[f"- {r['source']} -> {r['target']}: {r['type']}, lag {r['lag']}, confidence {r['confidence']:.2f} ({', '.join(r['methods'])})" for r in m.relations]]
    lines += ["", "## Rules", "", *[f"- {rule_text(r)} (support {r['support']:.2f}, precision {r['precision']:.2f})" for r in m.rules]]
    lines += ["", "## Modes", "", *[f"- {x['description']} ({x['prevalence']:.0%})" for x in m.modes]]
    lines += ["", "## Transitions", "", *[f"- {t['from_mode']} -> {t['to_mode']}: {t['n']} times, p {t['probability']:.2f}" for t in m.transitions]]
    lines += ["", "## Contradictions", "", *[f"- {c['kind']} ({c['severity']}): {c.get('source') or c.get('variable')} / {c['target']}" for c in m.contradictions]]
    lines += ["", "## Graph", "", "```mermaid", "graph LR", *[f"    {e['source']} --> {e['target']}" for e in m.graph.get("edges", [])], "```", ""]
    return "\n".join(lines)


def theory_files(t: Theory, folder: str) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "theory.json").write_text(json.dumps(plain(asdict(t)), indent=1))
    lines = ["# Operational theory", "", *t.narrative, "", "## Subsystems", "", *[f"- {s['name']}: {', '.join(s['variables'])}. {s['description']}" for s in t.subsystems]]
    lines += ["", "## Influence chains", "", *[f"- {c['text']}" for c in t.chains], "", "## Feedback loops", "", *[f"- {' -> '.join(x['path'])} ({x['polarity']})" for x in t.loops]]
    lines += ["", "## States", "", *[f"- {s['name']} ({s['mode']}, {s['prevalence']:.0%}). {s['description']}." for s in t.states], "", "```mermaid", t.mermaid, "```", "", "## Equations", ""]
    lines += [f"- {e['target']} from {', '.join(e['sources'])}: {e['kind']}, r2 {e['r2']:.3f}" for e in t.equations]
    lines += ["", "## Contradictions", "", *[f"- {c['kind']}: {c['rationale']}" for c in t.contradictions], "", "## Aliases", "", *[f"- {k} is {v}" for k, v in t.aliases.items()], ""]
    (out / "theory.md").write_text("\n".join(lines))
    (out / "twin.py").write_text(twin_script(t))


def twin_script(t: Theory) -> str:
    """A script without dependencies that steps the twin over a few rows."""
    data = {"variables": t.variables, "equations": t.equations, "states": t.states, "transitions": t.transitions}
    return f'''"""A digital twin; run it, or import step()."""
import json, operator, re

MODEL = json.loads({json.dumps(json.dumps(plain(data)))})
OPS = {{">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq}}
MODE = MODEL["states"][0]["name"] if MODEL["states"] else None
CENTRE = next((s["centroid"] for s in MODEL["states"] if s["name"] == MODE), {{}})
STATE = {{v: CENTRE.get(v) or 0.0 for v in MODEL["variables"]}}
PAST = {{v: [] for v in STATE}}


def step(inputs):
    global MODE
    STATE.update({{k: float(v) for k, v in inputs.items() if k in STATE}})
    for v in STATE:
        PAST[v].append(STATE[v])
    new = {{}}
    for e in MODEL["equations"]:
        if e["target"] in inputs:
            continue
        x = [PAST[a][-1 - k] if k < len(PAST[a]) else PAST[a][0] for a, k in zip(e["sources"], e["lags"])]
        terms = [x[0], x[0] ** 2] if e["kind"] == "quadratic" else x
        new[e["target"]] = e["intercept"] + sum(c * v for c, v in zip(e["coef"], terms))
    STATE.update(new)
    fired = []
    for t in MODEL["transitions"]:
        m = re.match(r"(.+?) (>=|<=|==|>|<) (.+)", t["trigger"])
        if t["from_state"] == MODE and m and m[1] in STATE and OPS[m[2]](STATE[m[1]], float(m[3])):
            fired.append(t)
    if fired:
        MODE = max(fired, key=lambda t: t["probability"])["to_state"]
    return dict(STATE), MODE


if __name__ == "__main__":
    for _ in range(5):
        print(step({{}}))
'''
