"""From a system model to an operational theory: subsystems, influence, states, equations and a narrative."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.functions.tails import t_two_sided
from strandline.operators.knowledge import SystemModel
from strandline.operators.ordered import shifted
from strandline.operators.stats import numeric_columns, pair_moments
from strandline.operators.tables import saved
from strandline.schema import TheorySettings

#: Categories of subsystems and words that variables of each contain.
CATEGORIES = {
    "Thermal Subsystem": "temp temperature thermal heat cool degc degf celsius kelvin",
    "Power Subsystem": "volt voltage curr current batt battery power amp energy draw",
    "Actuation Subsystem": "speed rpm velocity mot motor rot rotor thrust spin",
    "Attitude & Control Subsystem": "pitch roll yaw att attitude gyro acc accel angle",
    "Navigation Subsystem": "pos position alt altitude lat lon gps nav navigation",
    "Communication Subsystem": "comm signal rssi packet telemetry link tx rx",
    "Health & Diagnostics Subsystem": "err error fail status health warn warning fault",
}
#: Names of states (fixed values) and what they stand for.
STATES = {
    "Idle State": "Little is driven",
    "Thermal Stress State": "Temperatures are near their highest",
    "Low Power / Critical State": "Stored power is near its lowest",
    "High-Load Operational State": "Drives are near their highest",
    "Nominal Operational State": "Nothing stands out",
}
#: How the names of variables begin whose high or low places name a state.
HOT, DRAINED, DRIVEN = ("temp",), ("battery", "voltage"), ("motor_speed", "speed", "current_draw")


@dataclass
class Theory:
    variables: list[str]
    aliases: dict[str, str] = field(default_factory=dict)
    subsystems: list[dict] = field(default_factory=list)
    chains: list[dict] = field(default_factory=list)
    loops: list[dict] = field(default_factory=list)
    states: list[dict] = field(default_factory=list)
    transitions: list[dict] = field(default_factory=list)
    equations: list[dict] = field(default_factory=list)
    contradictions: list[dict] = field(default_factory=list)
    narrative: list[str] = field(default_factory=list)
    mermaid: str = ""


def aliases(variables: list[str], findings: list[dict]) -> dict[str, str]:
    """alias -> canonical name: correlated at 0.98 and named alike (equal first four letters, or one in the other)."""
    out: dict[str, str] = {}
    for f in findings:
        a, b = f["a"], f["b"]
        x, y = a.lower(), b.lower()
        if f["metric"] in ("pearson", "spearman") and abs(f["value"]) >= 0.98 and a not in out and b not in out and (x[:4] == y[:4] or x in y or y in x):
            keep, drop = (a, b) if len(a) <= len(b) else (b, a)
            out[drop] = keep
    return {k: v for k, v in out.items() if k in variables}


def nearest_centroid(df: DataFrame, centroids: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """df with the label of the nearest centroid by squared Euclidean distance over a centroid's non-null columns; ties go
    to the lesser label. centroids: a row a mode (bounded by the number of modes), sent to every task."""
    c = centroids.select(F.col(label).alias("_label"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    one = c.agg(F.collect_list(F.struct(*c.columns)).alias("_all"))
    inside = df.crossJoin(F.broadcast(one))
    dist = F.transform("_all", lambda m: F.struct(sum((F.coalesce(F.pow(F.col(x) - m[f"_c_{x}"], 2), F.lit(0.0)) for x in columns), F.lit(0.0)).alias("d"), m["_label"].alias("l")))
    return inside.withColumn(label, F.array_min(dist)["l"]).drop("_all")


def complete_linkage(d: np.ndarray, cut: float, most: int) -> list[list[int]]:
    """Clusters of a distance matrix: merged while the farthest members are within cut, then on down to `most`."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        far = [(max(d[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j]
        worst, i, j = min(far)
        if worst > cut and len(groups) <= most:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def distances(variables: list[str], moments: list | None = None, findings: list[dict] | None = None, relations: list[dict] | None = None) -> np.ndarray:
    """Distances of variables: 1 - |r| of each pair of a matrix (moments: rows a, b, r; a pair without r is 1 apart). Without
    a matrix, of the findings of correlation, the last of a pair, and no more than 1 - confidence of its relations."""
    d = np.ones((len(variables), len(variables)))
    np.fill_diagonal(d, 0)
    at = {v: i for i, v in enumerate(variables)}

    def put(a: str, b: str, x: float, least: bool = False) -> None:
        if a in at and b in at and a != b:
            i, j = at[a], at[b]
            x = float(np.clip(x, 0, 1))
            d[i, j] = d[j, i] = min(d[i, j], x) if least else x

    if moments is not None:
        for m in moments:
            put(m["a"], m["b"], 1 - abs(m["r"] or 0.0))
        return d
    for f in findings or []:
        if f["metric"] in ("pearson", "spearman"):
            put(f["a"], f["b"], 1 - abs(f["value"]))
    for r in relations or []:
        put(r["source"], r["target"], 1 - r["confidence"], True)
    return d


def subsystems(variables: list[str], d: np.ndarray, s: TheorySettings) -> list[dict]:
    """Clusters of a distance matrix, named by the category most of their variables belong to."""
    if not variables:
        return []
    out, used = [], {}
    for g in complete_linkage(d, s.cut, s.max_subsystems):
        names = [variables[i] for i in g]
        hits = {c: sum(any(w in v.lower() for w in words.split()) for v in names) for c, words in CATEGORIES.items()}
        top = max(hits, key=hits.get)
        name = top if hits[top] else f"{names[0].capitalize()} Subsystem"
        used[name] = used.get(name, 0) + 1
        off = [d[i, j] for i in g for j in g if i < j]
        coherence = 1 - float(np.mean(off)) if off else 1.0
        word = "high" if coherence > 0.6 else "moderate" if coherence > 0.3 else "low"
        out.append({"name": name if used[name] == 1 else f"{name} {used[name]}", "variables": names, "coherence": coherence, "description": f"{len(names)} variable(s) with {word} coherence ({coherence:.2f})"})
    return sorted(out, key=lambda x: x["name"])


#: Words of a relation's description that make its sign negative.
AGAINST = ("decrease", "negative")


def edges_of(relations: list[dict], signs: dict[tuple[str, str], int], s: TheorySettings) -> dict[tuple[str, str], dict]:
    """Edges of influence by (source, target), of relations in order: a later one takes the place of an earlier one. The sign
    is the pair's correlation's, unless the relation's description says otherwise."""
    out = {}
    for r in relations:
        if r["type"] in ("INFLUENCES", "TRIGGERS", "THRESHOLD") and r["confidence"] >= s.min_confidence and r["source"] != r["target"]:
            out[r["source"], r["target"]] = {"confidence": r["confidence"], "lag": r["lag"] or 0.0, "best_lag": r.get("best_lag"), "sign": -1 if any(w in (r.get("description") or "").lower() for w in AGAINST) else signs.get(tuple(sorted((r["source"], r["target"]))), 1)}
    return out


def _surest(out: dict[str, list[str]], edges: dict[tuple[str, str], dict], starts: list[str], leaves: set[str], length: int) -> Iterator[tuple[float, list[str]]]:
    """(confidence, path) of the simple paths of exactly `length` edges from starts to leaves, surest first and then by name.

    Branch and bound: a path is no surer than its beginning, so beginnings wait in order of that bound, and only as many are
    gone into as answers are taken. Beginnings that no walk of the right length leads on to a leaf are left out."""
    ends = [leaves]
    for _ in range(length):
        ends.append({a for a in out if any(b in ends[-1] for b in out[a])})
    heap = [(-1.0, [a]) for a in starts if a in ends[length]]
    heapq.heapify(heap)
    while heap:
        bound, path = heapq.heappop(heap)
        left = length - len(path) + 1
        if not left:
            yield -bound, path
            continue
        for b in out.get(path[-1], []):
            if b not in path and b in ends[left - 1]:
                heapq.heappush(heap, (max(bound, -edges[path[-1], b]["confidence"]), [*path, b]))


def chains(edges: dict[tuple[str, str], dict], most: int = 12, length: int = 4) -> list[dict]:
    """Simple paths of at most `length` edges from sources to leaves (from and to any node where there are none), longest
    and surest first, without those inside another. The graph has a node a variable, so it is small; the search ends with
    the last chain that is asked for, however many there are."""
    out: dict[str, list[str]] = {}
    nodes = sorted({n for e in edges for n in e})
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    targets = {b for _, b in edges}
    starts = [n for n in nodes if n not in targets] or nodes
    leaves = {n for n in nodes if n not in out} or set(nodes)
    kept: list[dict] = []
    for n in range(length, 0, -1):
        for confidence, path in _surest(out, edges, starts, leaves, n):
            if len(kept) == most:
                break
            # shorter ones come only after all longer ones, so those that hold them are here
            if not any(path == k["path"][i : i + n + 1] for k in kept for i in range(len(k["path"]) - n)):
                lag = sum(edges[e]["lag"] for e in zip(path, path[1:], strict=False))
                kept.append({"path": path, "confidence": confidence, "lag": lag, "text": " -> ".join(path) + f" (lag {lag:.1f})"})
    return kept


def _circles(out: dict[str, list[str]]) -> dict[str, int]:
    """The strongly connected component of each node (Tarjan 1972, without recursion)."""
    at: dict[str, int] = {}
    low: dict[str, int] = {}
    found: dict[str, int] = {}
    stack: list[str] = []
    for root in sorted(out):
        work = [(root, iter(out.get(root, [])))] if root not in at else []
        if work:
            at[root] = low[root] = len(at)
            stack.append(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in at:
                    at[n] = low[n] = len(at)
                    stack.append(n)
                    work.append((n, iter(out.get(n, []))))
                    break
                if n not in found:
                    low[node] = min(low[node], at[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == at[node]:
                    while True:
                        n = stack.pop()
                        found[n] = at[node]
                        if n == node:
                            break
    return found


def loops(edges: dict[tuple[str, str], dict], longest: int | None = None) -> list[dict]:
    """Simple cycles of 2 nodes and more (at most `longest`, if given), each from its least node. Paths stay inside strongly
    connected components, outside of which nothing returns; a dense graph still has as many cycles as it has."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    circle = _circles(out)
    out = {a: [b for b in bs if circle[b] == circle[a]] for a, bs in out.items()}
    found, todo = [], [[n] for n in sorted(out)]
    while todo:
        path = todo.pop()
        for n in out.get(path[-1], []):
            if n == path[0] and len(path) > 1:
                es = [edges[p] for p in zip(path, [*path[1:], path[0]], strict=True)]
                sign = int(np.prod([e["sign"] for e in es]))
                found.append({"path": path, "confidence": float(np.mean([e["confidence"] for e in es])), "polarity": "positive" if sign > 0 else "negative"})
            elif n > path[0] and n not in path and (longest is None or len(path) < longest):
                todo.append([*path, n])
    return sorted(found, key=lambda c: (-c["confidence"], c["path"]))


def states(found: list[dict]) -> list[dict]:
    """Names of modes by where their centroids lie between the least and the greatest over all modes."""
    out, used = [], {}
    names = sorted({v for m in found for v in m["centroid"]})
    low = {v: min(m["centroid"].get(v, 0.0) for m in found) for v in names}
    high = {v: max(m["centroid"].get(v, 0.0) for m in found) for v in names}
    for m in found:
        where = {v: (m["centroid"][v] - low[v]) / (high[v] - low[v]) for v in m["centroid"] if high[v] > low[v]}
        up, down = [v for v in where if where[v] >= 0.75], [v for v in where if where[v] <= 0.25]
        some = lambda names, starts: any(v.lower().startswith(starts) for v in names)
        if some(down, DRIVEN) and len(down) >= 0.5 * len(m["centroid"]):
            name = "Idle State"
        elif some(up, HOT):
            name = "Thermal Stress State"
        elif some(down, DRAINED):
            name = "Low Power / Critical State"
        elif some(up, DRIVEN):
            name = "High-Load Operational State"
        else:
            name = "Nominal Operational State"
        told = [f"{word} {', '.join(vs)}" for word, vs in (("high", up), ("low", down)) if vs]
        description = f"{STATES[name]}: {'; '.join(told)}" if told else STATES[name]
        used[name] = used.get(name, 0) + 1
        out.append({"mode": m["label"], "name": name if used[name] == 1 else f"{name} {used[name]}", "description": description, "prevalence": m["prevalence"], "high": up, "low": down, "centroid": m["centroid"]})
    return out


def stump(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """(variable, threshold, gini, above): the best one-split Gini classifier of a 0/1 label for each variable.

    Distinct values are counted first and then run through in order, so windows are over values, not rows."""
    long = df.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns]))).filter("v IS NOT NULL")
    return _best_splits(long.groupBy("variable", "v").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("k")))


def _best_splits(by: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """stump() of counts by value (variable, v, n: rows, k: those of label 1), for each value of the keys."""
    w = W.Window.partitionBy(*keys, "variable").orderBy("v")
    run, whole = w.rowsBetween(W.Window.unboundedPreceding, 0), W.Window.partitionBy(*keys, "variable")
    by = by.select(*keys, "variable", "v", F.lead("v").over(w).alias("next"), F.sum("n").over(run).alias("ln"), F.sum("k").over(run).alias("lk"), F.sum("n").over(whole).alias("tn"), F.sum("k").over(whole).alias("tk")).filter("next IS NOT NULL")
    side = lambda n, k: F.lit(2.0) * k * (n - k) / n
    rn, rk = F.col("tn") - F.col("ln"), F.col("tk") - F.col("lk")
    by = by.select(*keys, "variable", ((F.col("v") + F.col("next")) / 2).alias("threshold"), ((side(F.col("ln"), F.col("lk")) + side(rn, rk)) / F.col("tn")).alias("gini"), (rk * F.col("ln") > F.col("lk") * rn).alias("above"))
    return by.groupBy(*keys, "variable").agg(F.min(F.struct(F.round("gini", 12).alias("gini"), "threshold", "above")).alias("s")).select(*keys, "variable", "s.threshold", "s.gini", "s.above")


def next_modes(df: DataFrame, labels: DataFrame, ts: str) -> DataFrame:
    """df with each row's mode and `_next`, that of the row behind it, as a written table: every transition reads it."""
    return saved(shifted(df.join(labels, ts), ts, {"_next": ("mode", -1)}))


def trigger_rule(df: DataFrame, labels: DataFrame | None, ts: str, columns: list[str], source: str, target: str) -> str:
    """What tells rows just before source -> target from rows that stay in source; N/A without at least one and two.
    labels: None if df comes from next_modes()."""
    both = df if labels is None else next_modes(df, labels, ts)
    both = both.filter(F.col("mode") == source).withColumn("y", F.when(F.col("_next") == target, 1).when(F.col("_next") == source, 0)).filter("y IS NOT NULL")
    both = both.select("y", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    n = both.agg(F.sum("y"), F.count("*")).first()
    if not n[0] or n[1] - n[0] < 2:
        return "N/A"
    best = stump(both, columns).orderBy("gini", "variable").first()
    if best:
        return f"{best.variable} {'>' if best.above else '<='} {best.threshold:.4g}"
    return by_means(both, columns)


def trigger_rules(steps: DataFrame, columns: list[str], moves: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """trigger_rule() of all moves (source, target) at once: values are counted once by mode and next mode, and each move takes
    the counts of its own two. steps: from next_modes()."""
    long = steps.select("mode", "_next", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in columns])))
    counts = saved(long.filter("mode IS NOT NULL AND _next IS NOT NULL").groupBy("mode", "_next", "variable", "v").agg(F.count("*").alias("n")))
    size = {(r.mode, r["_next"]): r.n for r in counts.filter(F.col("variable") == columns[0]).groupBy("mode", "_next").agg(F.sum("n").alias("n")).collect()}
    able = [m for m in moves if size.get(m, 0) >= 1 and size.get((m[0], m[0]), 0) >= 2]
    out = {m: "N/A" for m in moves}
    if not able:
        return out
    sides = steps.sparkSession.createDataFrame([(s, t, x) for s, t in able for x in (s, t)], "source string, target string, _to string")
    by = counts.join(F.broadcast(sides), (F.col("mode") == F.col("source")) & (F.col("_next") == F.col("_to")))
    by = by.groupBy("source", "target", "variable", "v").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_next") == F.col("target"), F.col("n")).otherwise(0)).alias("k"))
    best = _best_splits(by, ("source", "target")).groupBy("source", "target").agg(F.min(F.struct("gini", "variable", "threshold", "above")).alias("b"))
    for r in best.collect():
        out[r.source, r.target] = f"{r.b.variable} {'>' if r.b.above else '<='} {r.b.threshold:.4g}"
    for m in able:
        # nothing can be split: the means decide
        if out[m] == "N/A":
            out[m] = trigger_rule(steps, None, "", columns, *m)
    return out


def by_means(rows: DataFrame, columns: list[str], label: str = "y") -> str:
    """The middle between the means of both classes for the variable whose means differ most, in standard deviations of
    class 0: what is left where no variable can be split."""
    of = lambda f, c, k: f(F.when(F.col(label) == k, F.col(c)))
    r = rows.agg(*[x for i, c in enumerate(columns) for x in (of(F.avg, c, 1).alias(f"a{i}"), of(F.avg, c, 0).alias(f"b{i}"), of(F.stddev_samp, c, 0).alias(f"s{i}"))]).first()
    far = [(abs(r[f"a{i}"] - r[f"b{i}"]) / (r[f"s{i}"] or 1.0), -i) for i in range(len(columns)) if r[f"a{i}"] is not None and r[f"b{i}"] is not None]
    if not far:
        return "N/A"
    i = -max(far)[1]
    a, b = r[f"a{i}"], r[f"b{i}"]
    return f"{columns[i]} {'>' if a > b else '<='} {(a + b) / 2:.4g}"


def median_step(df: DataFrame, ts: str, ties: list[str] | None = None) -> float:
    """Median time between rows; 1 where there is none above 0."""
    d = shifted(df.select(ts, *(ties or [])), ts, {"_past": (ts, 1)}, ties)
    kind = df.schema[ts].dataType.simpleString()
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)) if kind.startswith("timestamp") else (lambda c: F.col(c).cast("double"))
    dt = d.agg(F.median(number(ts) - number("_past"))).first()[0]
    return float(dt) if dt and dt > 0 else 1.0


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with intercept from whole columns: coefficients, p values, r2 and mse."""
    m = np.concatenate([np.ones((len(y), 1)), x], 1)
    return ols_gram(m.T @ m, m.T @ y, float(y @ y), len(y), float(y.sum()))


def ols_gram(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, y_sum: float) -> dict:
    """The same from sums of products (intercept first), which are aggregates of any size of table."""
    inv = np.linalg.pinv(gram)
    beta = inv @ xy
    k = len(beta) - 1
    ssr = max(0.0, yy - float(beta @ xy))
    sst = yy - y_sum * y_sum / n
    df = n - k - 1
    var = ssr / df if df > 0 else np.nan
    se = np.sqrt(np.maximum(np.diag(inv) * var, 0))
    p = [t_two_sided(b / e, df) if e > 0 and df > 0 else 0.0 for b, e in zip(beta, se, strict=True)]
    return {"intercept": float(beta[0]), "coef": [float(b) for b in beta[1:]], "p": p[1:], "r2": 1 - ssr / sst if sst > 0 else 0.0, "mse": var}


def gram(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int, float] | None:
    """Sums of products of complete rows, in one aggregate."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    t = F.col(y).cast("double")
    full = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*xs, y]))
    k = len(cols)
    aggs = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * t) for c in cols] + [F.sum(t * t), F.count("*"), F.sum(t)]
    row = list(full.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first())
    if not row[-2]:
        return None
    g, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[at]
            at += 1
    return g, np.array(row[at : at + k], float), float(row[at + k]), int(row[-2]), float(row[-1])


def equations(df: DataFrame, ts: str, edges: dict[tuple[str, str], dict], found: list[dict], s: TheorySettings) -> list[dict]:
    """A regression of each influenced variable on its lagged parents; on the modes' centroids where data don't do."""
    out = []
    for target in sorted({b for _, b in edges}):
        parents = sorted({a for a, b in edges if b == target and a in df.columns})
        eq = None
        if parents and target in df.columns:
            lags = {a: int(edges[a, target].get("best_lag") or round(edges[a, target]["lag"])) for a in parents}
            moved = shifted(df.select(ts, F.col(target).alias("_y"), *[F.col(a) for a in parents if a != ts]), ts, {f"_m{i}": (a, lags[a]) for i, a in enumerate(parents)})
            eq = _fit(moved.select("_y", *[F.col(f"_m{i}").alias(a) for i, a in enumerate(parents)]), parents, s)
            if eq:
                eq["lags"] = [lags[a] for a in eq["sources"]]
        if eq is None:
            eq = _from_centroids(target, sorted(((edges[a, target]["confidence"], a) for a, b in edges if b == target), key=lambda x: (-x[0], x[1])), found, s)
        if eq:
            out.append({"target": target, **eq})
    return out


def _fit(df: DataFrame, parents: list[str], s: TheorySettings) -> dict | None:
    g = gram(df, parents, "_y")
    if g is None or g[3] < 15:
        return None
    fit, names = ols_gram(*g), parents
    keep = [a for a, p in zip(parents, fit["p"], strict=True) if p <= s.p_max]
    if keep and len(keep) < len(parents):
        fit, names = ols_gram(*gram(df, keep, "_y")), keep
    kind = "linear"
    if len(names) == 1 and s.max_degree >= 2:
        sq = df.withColumn("_sq", F.col(names[0]) * F.col(names[0]))
        g2 = gram(sq, [names[0], "_sq"], "_y")
        quad = ols_gram(*g2)
        if quad["r2"] > fit["r2"] + 0.05:
            quad["mse"] *= (g2[3] - 3) / g2[3]
            fit, kind = quad, "quadratic"
    return {"sources": names, "kind": kind, **{k: fit[k] for k in ("intercept", "coef", "r2", "mse")}} if fit["r2"] >= s.min_r2 else None


def _from_centroids(target: str, parents: list[tuple[float, str]], found: list[dict], s: TheorySettings) -> dict | None:
    for _, a in parents[:1]:
        pts = [(m["centroid"][a], m["centroid"][target]) for m in found if a in m["centroid"] and target in m["centroid"]]
        if len(pts) >= 2 and max(p[0] for p in pts) - min(p[0] for p in pts) >= 1e-6:
            x, y = np.array(pts).T
            fit = ols(x[:, None], y)
            if fit["r2"] >= s.min_r2:
                return {"sources": [a], "kind": "centroid", "lags": [0], **{k: fit[k] for k in ("intercept", "coef", "r2", "mse")}}
    return None


def mermaid(found: list[dict], moves: list[dict]) -> str:
    names = {s["mode"]: re.sub(r"\W+", "_", s["name"]) for s in found}
    return "\n".join(["stateDiagram-v2", *[f"    {names[t['from_mode']]} --> {names[t['to_mode']]}: {t['trigger']} ({t['probability']:.0%})" for t in moves if t["from_mode"] in names and t["to_mode"] in names]])


def resolve(contradictions: list[dict], model: SystemModel) -> list[dict]:
    """Each contradiction with both sides, what each is sure of (one half if it isn't known), and the surer one; of equal
    ones the first: the correlation before the rule or relation, source -> target before target -> source."""
    pair = lambda a, b: tuple(sorted((a, b)))
    findings = {(*pair(f["a"], f["b"]), f["metric"]): f["confidence"] for f in model.findings}
    relations = {(r["source"], r["target"]): r["confidence"] for r in model.relations}
    rules = {(r["target"], r["conditions"][0]["variable"]): r["confidence"] for r in model.rules if len(r["conditions"]) == 1}
    out = []
    for c in contradictions:
        a, b = c.get("source") or c.get("variable"), c.get("target")
        if c.get("kind") == "bidirectional":
            sides = [("relation", f"{a} -> {b}", relations.get((a, b), 0.5)), ("reverse", f"{b} -> {a}", relations.get((b, a), 0.5))]
        else:
            first = ("finding", f"{c.get('metric')} of {a} and {b}", findings.get((*pair(a, b), c.get("metric")), 0.5))
            other = ("rule", f"rule of {b} by {a}", rules.get((b, a), 0.5)) if c.get("kind") == "rule_sign" else ("relation", f"{a} -> {b}", relations.get((a, b), 0.5))
            sides = [first, other]
        kept, left = (sides[0], sides[1]) if sides[0][2] >= sides[1][2] else (sides[1], sides[0])
        out.append({
            **c, "resolution": kept[0], "confidence": kept[2], "primary_explanation": kept[1], "rejected_explanation": left[1], "confidence_delta": kept[2] - left[2],
            "rationale": f"{kept[1]} is kept, being {'surer' if kept[2] > left[2] else 'no less sure'} ({kept[2]:.2f} against {left[2]:.2f}).",
        })
    return out


def synthesize(model: SystemModel, df: DataFrame | None = None, ts: str = "ts", settings: TheorySettings | None = None) -> Theory:
    s = settings or TheorySettings()
    same = aliases(model.variables, model.findings)
    names = [v for v in model.variables if v not in same]
    numbers = numeric_columns(df, [v for v in names if v in df.columns]) if df is not None else []
    moments = pair_moments(df, numbers).collect() if len(numbers) > 1 else None
    signs = {tuple(sorted((f["a"], f["b"]))): (1 if f["value"] > 0 else -1) for f in model.findings if f["metric"] in ("pearson", "spearman")}
    edges = edges_of([x for x in model.relations if x["source"] in names and x["target"] in names], signs, s)
    t = Theory(names, same, subsystems(names, distances(names, moments, model.findings, model.relations), s), chains(edges), loops(edges, s.max_loop), states(model.modes) if model.modes else [])
    by = {x["mode"]: x["name"] for x in t.states}
    steps = next_modes(df, model.labels, ts) if df is not None and model.labels is not None and model.transitions else None
    told = trigger_rules(steps, names, [(m["from_mode"], m["to_mode"]) for m in model.transitions]) if steps is not None else {}
    for m in model.transitions:
        t.transitions.append({**m, "from_state": by.get(m["from_mode"]), "to_state": by.get(m["to_mode"]), "trigger": told.get((m["from_mode"], m["to_mode"]), "N/A")})
    t.mermaid = mermaid(t.states, t.transitions)
    t.equations = equations(df.select(ts, *names), ts, edges, model.modes, s) if df is not None else []
    t.contradictions = resolve(model.contradictions, model)
    t.narrative = narrative(t)
    return t


def narrative(t: Theory) -> list[str]:
    out = [f"{len(t.variables)} variables form {len(t.subsystems)} subsystem(s): " + ", ".join(x["name"] for x in t.subsystems) + "."]
    if t.chains:
        out.append(f"The longest chain of influence is {t.chains[0]['text']}.")
    if t.loops:
        out.append(f"{len(t.loops)} feedback loop(s) close, the surest over " + ", ".join(t.loops[0]["path"]) + f" ({t.loops[0]['polarity']}).")
    if t.states:
        out.append("Operation moves among " + ", ".join(x["name"] for x in t.states) + ".")
    if t.equations:
        best = max(t.equations, key=lambda e: e["r2"])
        out.append(f"{best['target']} follows {', '.join(best['sources'])} best (r2 {best['r2']:.2f}).")
    return out
