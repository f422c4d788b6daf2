"""From statistics to a system model: rules, modes, transitions, merging, contradictions and the graph."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.operators import clusters, stats, trees
from strandline.operators.ordered import shifted
from strandline.operators.tables import saved
from strandline.schema import DiscoverySettings


# --- rules ---------------------------------------------------------------------------------------------------------


RULE = "target string, conditions array<struct<variable:string,operator:string,threshold:double>>, direction string, magnitude string, support double, precision double, confidence double"


def rules(df: DataFrame, columns: list[str], s: DiscoverySettings | None = None) -> DataFrame:
    """Threshold rules for every column from the others: regression trees on complete rows, grown for all targets at once
    from counts (see trees.grow). Fewer than 30 complete rows, or than four leaves', give none."""
    s = s or DiscoverySettings()
    numbers = df.select([F.col(c).cast("double").alias(c) for c in columns])
    full = numbers.dropna()
    spark = df.sparkSession
    about = full.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    n = about["n"]
    if len(columns) < 2 or n < max(30, 4 * s.leaf_rows):
        return spark.createDataFrame([], RULE)
    mean, std = [about[f"m{i}"] for i in range(len(columns))], [about[f"s{i}"] for i in range(len(columns))]
    # a column that doesn't vary is never split: no leaf is as large
    leaf = [max(s.leaf_rows, int(s.rule_support * n)) if d > 1e-10 else n for d in std]
    total = numbers.count()
    grown, rows = trees.grow(full, columns, min(s.tree_depth, s.rule_conditions), leaf)
    table = lambda xs: F.array(*[F.lit(x) for x in xs])
    each = rows.select(F.inline(F.transform("nodes", lambda node, i: F.struct(i.alias("t"), node.alias("node"), F.get("v", i).alias("y"), F.get(table(mean), i).alias("m")))))
    leaves = each.groupBy("t", "node").agg(F.count("*").alias("k"), F.avg("y").alias("y"), F.avg((F.col("y") > F.col("m")).cast("double")).alias("above"), F.avg((F.col("y") < F.col("m")).cast("double")).alias("below"))
    out = []
    for r in leaves.orderBy("t", "node").collect():
        conditions = trees.path(grown[r.t], r.node)
        support, delta = r.k / total, r.y - mean[r.t]
        precision = r.above if delta > 0 else r.below
        if not conditions or support < s.rule_support or precision < s.rule_precision:
            continue
        z = abs(delta) / (std[r.t] + 1e-10)
        words = "very strongly" if z >= 2 else "strongly" if z >= 1 else "moderately" if z >= 0.5 else "slightly"
        confidence = float(np.clip(support**0.3 * precision * (1 - 0.05 * (len(conditions) - 1)), 0, 1))
        out.append((columns[r.t], [(columns[j], op, th) for j, op, th in conditions], "increase" if delta > 0 else "decrease", words, support, precision, confidence))
    return spark.createDataFrame(out, RULE)


def rule_text(rule) -> str:
    return "IF " + " AND ".join(f"{c['variable']} {c['operator']} {c['threshold']:.4g}" for c in rule["conditions"]) + f" THEN {rule['target']} {rule['magnitude']} {rule['direction']}s"


# --- modes and transitions -----------------------------------------------------------------------------------------


@dataclass
class Modes:
    modes: list[dict] = field(default_factory=list)
    #: (ts, mode) of every row; rows in no mode are "noise".
    labels: DataFrame | None = None


def modes(df: DataFrame, ts: str, columns: list[str], s: DiscoverySettings | None = None, sample: int = clusters.SAMPLE_ROWS) -> Modes:
    """Operating modes by k-means over standardised columns, the best of several starts for each k; k by best Euclidean
    silhouette of a seeded sample of at most `sample` rows. Fitting, labelling and the modes' confidence run over all rows."""
    s = s or DiscoverySettings()
    stat = df.agg(F.count("*").alias("n"), *[F.median(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n, med = stat["n"], {c: stat[f"m{i}"] for i, c in enumerate(columns) if stat[f"m{i}"] is not None}
    columns = list(med)
    if n < max(20, 2 * s.cluster_size) or not columns:
        return Modes()
    whole = df.select(F.col(ts), *[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in columns])
    mom = whole.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean, std = [mom[f"a{i}"] for i in range(len(columns))], [mom[f"s{i}"] or 0.0 for i in range(len(columns))]
    scaled = [(F.col(c) - m) / (d if d else 1.0) for c, m, d in zip(columns, mean, std, strict=True)]
    rows = saved(whole.select("*", F.array(*scaled).alias("_z")))
    some = clusters.sample_of(rows, ts, "_z", s.seed, sample)
    points = np.stack(some["_z"].to_numpy())
    fits = clusters.kmeans(rows, "_z", list(range(2, min(s.max_k, n // 5) + 1)), points, s.mode_starts, s.seed)
    best = None
    for k, centres in sorted(fits.items()):
        near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        score, _ = silhouette(points, near)
        if score is not None and (best is None or score > best[0]):
            best = (score, centres, near)
    if best is None or best[0] < 0.1:
        return Modes()
    out = clusters.labelled(rows, "_z", best[1])
    count = {r.prediction: r for r in out.groupBy("prediction").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{i}") for i, c in enumerate(columns)]).collect()}
    sure = clusters.silhouettes(out, ts, "_z", "prediction", some, best[2])
    found, names = [], {}
    for p, r in sorted(count.items(), key=lambda x: (-x[1].n, x[0])):
        if r.n / n < s.mode_prevalence:
            continue
        names[p] = f"Mode_{len(found)}"
        centre = {c: r[f"c{i}"] for i, c in enumerate(columns)}
        z = {c: (centre[c] - m) / (d + 1e-10) for c, m, d in zip(columns, mean, std, strict=True)}
        top = sorted(z, key=lambda c: -abs(z[c]))[: s.mode_features]
        found.append({"label": names[p], "centroid": centre, "member_count": r.n, "total_count": n, "prevalence": r.n / n, "features": top, "description": describe(names[p], z, top), "confidence": float((sure[p] + 1) / 2) if p in sure else 0.5})
    pick = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return Modes(found, out.select(ts, F.coalesce(F.try_element_at(pick, F.col("prediction")), F.lit("noise")).alias("mode")))


def describe(name: str, z: dict[str, float], top: list[str]) -> str:
    words = [f"{'very ' if abs(z[c]) >= 1.5 else 'slightly ' if abs(z[c]) < 0.5 else ''}{'high' if z[c] > 0 else 'low'} {c}" for c in top if abs(z[c]) >= 0.3]
    return f"{name}: {', '.join(words)}" if words else f"{name}: near the average"


def silhouette(x: np.ndarray, label: np.ndarray) -> tuple[float | None, np.ndarray]:
    """Mean and each row's Euclidean silhouette; None for fewer than two clusters."""
    kinds = np.unique(label)
    if len(kinds) < 2:
        return None, np.zeros(len(x))
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    sums = np.stack([d[:, label == k].sum(1) for k in kinds], 1)
    size = np.array([(label == k).sum() for k in kinds])
    own = np.searchsorted(kinds, label)
    i = np.arange(len(x))
    a = sums[i, own] / np.maximum(size[own] - 1, 1)
    other = sums / size
    other[i, own] = np.inf
    b = other.min(1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean()), s


def transitions(labels: DataFrame, ts: str, label: str = "mode", partition: list[str] | None = None) -> DataFrame:
    """(from_mode, to_mode, n, probability, confidence) of consecutive label changes; noise on either side doesn't count."""
    pairs = shifted(labels.select(ts, label, *(partition or [])), ts, {"from_mode": (label, 1)}, keys=partition).select("from_mode", F.col(label).alias("to_mode")).filter("from_mode <> to_mode AND from_mode <> 'noise' AND to_mode <> 'noise'")
    n = pairs.groupBy("from_mode", "to_mode").agg(F.count("*").alias("n"))
    p = n.withColumn("probability", F.col("n") / F.sum("n").over(W.Window.partitionBy("from_mode")))
    return p.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("probability") * F.log1p("n") / 3)))


# --- assembly ------------------------------------------------------------------------------------------------------


def merge(relations: DataFrame) -> DataFrame:
    """One relation for each (source, target, type): methods in order of their names, confidence raised by agreement, and
    the best lag of the last method that has one, if the relations have `best_lag`."""
    best = [F.max_by(F.col("best_lag"), F.when(F.col("best_lag").isNotNull(), F.col("method"))).alias("best_lag")] if "best_lag" in relations.columns else []
    out = relations.groupBy("source", "target", "type").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.max("confidence").alias("_top"), F.avg("lag").alias("lag"), F.avg("lag_confidence").alias("lag_confidence"), F.min("p").alias("p"), F.avg("coverage").alias("coverage"), *best)
    m = F.size("methods")
    out = out.withColumn("confidence", F.when(m > 1, F.least(F.col("_top") + 0.05 * (m - 1), F.lit(0.98))).otherwise(F.col("_top"))).drop("_top")
    return out.withColumn("evidence", stats.level(F.col("confidence")))


def confident(df: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows with at least this confidence; NaN doesn't count as high."""
    return df.filter((F.col("confidence") >= least) & ~F.isnan("confidence"))


def bidirectional(relations: DataFrame) -> DataFrame:
    """Pairs that influence each other both ways without lag: a row each way."""
    x, y = relations.alias("x"), relations.alias("y")
    both = x.join(y, (F.col("x.source") == F.col("y.target")) & (F.col("x.target") == F.col("y.source")) & (F.col("x.lag") == 0) & (F.col("y.lag") == 0))
    return both.select(F.col("x.source").alias("source"), F.col("x.target").alias("target"), F.lit("low").alias("severity")).distinct()


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def sign_conflicts(findings: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations by cross-correlation whose sign isn't that of the pair's correlation."""
    f = findings.filter(F.col("metric").isin("pearson", "spearman")).select(*[c.alias(n) for c, n in zip(_pair("a", "b"), ("p", "q"), strict=True)], F.col("value").alias("correlation"), "metric")
    r = relations.filter("method = 'cross_correlation'").select("source", "target", F.col("value").alias("peak"), *[c.alias(n) for c, n in zip(_pair("source", "target"), ("p", "q"), strict=True)])
    return r.join(f, ["p", "q"]).filter(F.signum("peak") != F.signum("correlation")).select("source", "target", "metric", "correlation", "peak", F.lit("medium").alias("severity"))


def rule_conflicts(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Rules with one condition whose direction isn't the sign of the pair's correlation (Spearman's if there is one)."""
    one = found.filter(F.size("conditions") == 1).select("target", F.col("conditions")[0]["variable"].alias("variable"), F.when((F.col("conditions")[0]["operator"] == ">") == (F.col("direction") == "increase"), 1).otherwise(-1).alias("sign"))
    one = one.select("*", *[c.alias(n) for c, n in zip(_pair("target", "variable"), ("p", "q"), strict=True)])
    f = findings.filter(F.col("metric").isin("pearson", "spearman")).select(*[c.alias(n) for c, n in zip(_pair("a", "b"), ("p", "q"), strict=True)], "metric", F.signum("value").cast("int").alias("s"))
    f = f.groupBy("p", "q").agg(F.max(F.struct("metric", "s")).alias("x")).select("p", "q", "x.metric", "x.s")
    return one.join(f, ["p", "q"]).filter("sign <> s").select("target", "variable", "metric", F.lit("medium").alias("severity")).distinct()


def edges_from(g: dict, node: str) -> list[dict]:
    return [e for e in g["edges"] if e["source"] == node]


def edges_to(g: dict, node: str) -> list[dict]:
    return [e for e in g["edges"] if e["target"] == node]


def add_node(g: dict, node: dict) -> None:
    """Adds a node; one of the same id is replaced."""
    g["nodes"] = [*(n for n in g["nodes"] if n["id"] != node["id"]), node]


def add_edge(g: dict, edge: dict) -> None:
    g["edges"].append(edge)


def graph(variables: list[str], relations: list[dict], found: list[dict], moves: list[dict], about: dict[str, dict] | None = None) -> dict:
    """Nodes (variables, with what a registry tells about them, and modes) and edges of the knowledge graph, small and on
    the driver."""
    nodes = [{"id": v, "type": "variable", **({"metadata": about[v]} if about and v in about else {})} for v in variables] + [{"id": m["label"], "type": "mode", "prevalence": m["prevalence"]} for m in found]
    edges = [{"source": r["source"], "target": r["target"], "relation_type": r["type"], "confidence": r["confidence"], "evidence_level": stats.level_of(r["confidence"]), "estimated_lag": r["lag"], "supporting_methods": r["methods"]} for r in relations]
    edges += [{"source": t["from_mode"], "target": t["to_mode"], "relation_type": "TRANSITIONS_TO", "confidence": t["confidence"], "evidence_level": stats.level_of(t["confidence"]), "estimated_lag": None, "supporting_methods": ["transitions"]} for t in moves]
    return {"nodes": list({n["id"]: n for n in nodes}.values()), "edges": edges}


@dataclass
class SystemModel:
    variables: list[str]
    rows: int
    findings: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    modes: list[dict] = field(default_factory=list)
    transitions: list[dict] = field(default_factory=list)
    contradictions: list[dict] = field(default_factory=list)
    graph: dict = field(default_factory=dict)
    labels: DataFrame | None = None


def about_variables(registry: DataFrame | None) -> dict[str, dict]:
    """What a registry tells about each variable: id, type, unit, source and metadata; a few values each."""
    if registry is None:
        return {}
    rows = [r.asDict(True) for r in registry.collect()]
    return {r["name"]: {**{k: v for k, v in r.items() if k not in ("name", "metadata") and v is not None}, **(r.get("metadata") or {})} for r in rows}


def as_matrix(spark: SparkSession, frame: pd.DataFrame, ts: str) -> DataFrame:
    """A pandas frame as a state matrix: its index is the time unless it has a column of that name."""
    if ts not in frame.columns:
        frame = frame.rename_axis(ts).reset_index()
    frame = frame.rename(columns=str)
    if pd.api.types.is_datetime64_any_dtype(frame[ts]):
        frame = frame.assign(**{ts: (pd.to_datetime(frame[ts], utc=True) - pd.Timestamp(0, tz="UTC")) / pd.Timedelta(seconds=1)})
    texts = {c: frame[c].map(lambda x: None if x is None or x != x else str(x)) for c in frame.columns if frame[c].dtype == object}
    return spark.createDataFrame(frame.assign(**texts))


def discover(df: DataFrame | pd.DataFrame, ts: str = "ts", settings: DiscoverySettings | None = None, registry: DataFrame | None = None) -> SystemModel:
    """A system model of a state matrix (a pandas frame is taken too). The matrix is cached once; what comes back is small
    (pairs, rules, modes). registry: what it tells about variables goes into the graph."""
    s = settings or DiscoverySettings()
    if isinstance(df, pd.DataFrame):
        df = as_matrix(SparkSession.active(), df, ts)
    spark = df.sparkSession
    columns = stats.numeric_columns(df, [c for c in df.columns if c != ts])
    df = df.select(ts, *[F.col(c).try_cast("double").alias(c) for c in columns]).cache()
    model = SystemModel(columns, df.count())
    if not columns:
        return model
    dicts = lambda d: [r.asDict(True) for r in d.collect()]
    if len(columns) > 1:
        findings = stats.correlations(df, ts, columns, s)
        relations = stats.lagged(df, ts, columns, s).cache()
        pairs = {tuple(sorted((f["a"], f["b"]))) for f in findings} | {tuple(sorted((r.source, r.target))) for r in relations.select("source", "target").collect()}
        strength = {tuple(sorted((r.a, r.b))): abs(r.r or 0) for r in stats.pair_moments(df, columns).collect()}
        chosen = sorted(pairs or strength, key=lambda p: (-strength.get(p, 0), p))[: s.granger_pairs]
        if chosen:
            relations = relations.unionByName(stats.causes(df, ts, chosen, s)).cache()
        f = spark.createDataFrame([tuple(x[c.split()[0]] for c in stats.FINDING.split(", ")) for x in findings], stats.FINDING)
        found = rules(df, columns, s).cache()
        model.findings = [x for x in findings if x["confidence"] >= s.min_confidence]
        merged = confident(merge(relations), s.min_confidence)
        model.relations = dicts(merged)
        values = {(r.source, r.target): r.value for r in relations.filter("method = 'cross_correlation'").collect()}
        for r in model.relations:
            r["value"] = values.get((r["source"], r["target"]))
        model.rules = dicts(confident(found, s.min_confidence))
        model.contradictions = [{"kind": k, **r} for k, d in (("rule_sign", rule_conflicts(f, found)), ("bidirectional", bidirectional(merged)), ("correlation_sign", sign_conflicts(f, relations))) for r in dicts(d)]
    m = modes(df, ts, columns, s)
    model.modes, model.labels = m.modes, m.labels
    if m.labels is not None:
        model.transitions = dicts(transitions(m.labels, ts).orderBy(F.desc("n"), "from_mode", "to_mode"))
    model.graph = graph(columns, model.relations, model.modes, model.transitions, about_variables(registry))
    return model
