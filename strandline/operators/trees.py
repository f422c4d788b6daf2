"""Regression trees for all targets at once, grown level by level from counts.

For every target, open node and feature the rows are summed by the feature's value (with map-side sums, a row a feature for all
targets and nodes), values run through
ranges of their order, and each place between two values gets its gain from running sums. No task holds a column of the
matrix: a range's rows are the most that any has.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.operators.tables import saved

#: A gain must exceed those of earlier features by this to be better.
CLOSE = 1e-12
#: Targets and nodes that are summed at once.
SUMS_AT_ONCE = 32


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float


#: Splits of each target by node: node 1 is the root, 2k and 2k + 1 are where node k sends rows at most and above its threshold.
Trees = list[dict[int, Split]]


def _range_of(value: Column, feature: Column, cuts: list[list[float]]) -> Column:
    """How many of the feature's cuts are not above the value, by halving."""
    most = max([len(c) for c in cuts] or [0])
    if not most:
        return F.lit(0)
    table = F.get(F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>"), feature)
    jumps = F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])

    def halved(at: Column) -> Column:
        return F.aggregate(jumps, F.lit(0), lambda n, h: F.when((n + h <= F.size(at)) & (F.get(at, n + h - 1) <= value), n + h).otherwise(n))

    return F.transform(F.array(table), halved)[0]


def _next_nodes(trees: Trees) -> Column:
    """The nodes of a row (`nodes`, one for each target) a level further down: a node without a split stays where it is."""
    table = [{str(k): {"f": s.feature, "t": s.threshold} for k, s in t.items()} for t in trees]
    splits = F.from_json(F.lit(json.dumps(table)), "array<map<string,struct<f:int,t:double>>>")

    def move(node: Column, i: Column) -> Column:
        found = F.try_element_at(F.get(splits, i), node.cast("string"))
        return F.transform(F.array(found), lambda s: F.when(s.isNull(), node).otherwise(2 * node + (F.get(F.col("v"), s["f"]) > s["t"]).cast("int")))[0]

    return F.transform("nodes", move)


def _best(rows: DataFrame, open_: list[list[int]], leaf: list[int], cuts: list[list[float]]) -> DataFrame:
    """(target, node, feature, threshold): the split of each open node that lowers the squared error most, of equal gains
    the first feature's and least value's; nodes without one have no row."""
    n = len(open_)
    features = F.array(*[F.struct(F.lit(j).alias("feature"), F.get("v", F.lit(j)).alias("x")) for j in range(n)])
    long = rows.select("v", "nodes", F.inline(features))
    wanted = [(t, node) for t, nodes in enumerate(open_) for node in nodes]
    found = []
    # counts of several targets and nodes come from one row a feature; wide matrices take several looks
    for at in range(0, len(wanted), SUMS_AT_ONCE):
        some = wanted[at : at + SUMS_AT_ONCE]
        here = [(F.get("nodes", F.lit(t)) == node, F.get("v", F.lit(t))) for t, node in some]
        sums = long.groupBy("feature", "x").agg(*[f for i, (w, y) in enumerate(here) for f in (F.count_if(w).alias(f"k{i}"), F.sum(F.when(w, y)).alias(f"s{i}"))])
        each = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(node).alias("node"), F.col(f"k{i}").alias("k"), F.col(f"s{i}").alias("s")) for i, (t, node) in enumerate(some)])
        found.append(sums.select("feature", "x", F.inline(each)).filter("k > 0 AND feature <> target"))
    key = ["target", "node", "feature"]
    values = reduce(DataFrame.unionByName, found).select(*key, "x", "k", "s").withColumn("part", _range_of(F.col("x"), F.col("feature"), cuts))
    inside = W.Window.partitionBy(*key, "part").orderBy("x")
    upto = inside.rowsBetween(W.Window.unboundedPreceding, 0)
    values = values.select(*key, "part", "x", F.sum("k").over(upto).alias("k"), F.sum("s").over(upto).alias("s"), F.lead("x").over(inside).alias("next"), F.row_number().over(inside).alias("place"))
    # a row a range: its last running sums and its least value
    ends = values.groupBy(*key, "part").agg(F.max("k").alias("k"), F.max_by("s", "place").alias("s"), F.min("x").alias("x"))
    over = W.Window.partitionBy(*key)
    ordered = over.orderBy("part")
    before = ordered.rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(c).alias(f"_{c}") for c in (*key, "part")],
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"),
        F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"),
        F.lead("x").over(ordered).alias("x1"),
        F.sum("k").over(over).alias("n"),
        F.sum("s").over(over).alias("total"),
    )
    same = [F.col(c) == F.col(f"_{c}") for c in (*key, "part")]
    at = values.join(ends, same).withColumns({"k": F.col("k") + F.col("k0"), "s": F.col("s") + F.col("s0"), "next": F.coalesce("next", "x1")})
    least = F.get(F.array(*[F.lit(x) for x in leaf]), F.col("target"))
    at = at.filter(F.col("next").isNotNull() & (F.col("k") >= least) & (F.col("n") - F.col("k") >= least))
    rest, left = F.col("n") - F.col("k"), F.col("total") - F.col("s")
    gain = F.col("s") * F.col("s") / F.col("k") + left * left / rest - F.col("total") * F.col("total") / F.col("n")
    at = at.select(*key, F.struct(gain.alias("gain"), (-F.col("x")).alias("back"), ((F.col("x") + F.col("next")) / 2).alias("threshold")).alias("c")).filter(F.col("c.gain") > CLOSE)
    each = at.groupBy(*key).agg(F.max("c").alias("c"))
    listed = each.groupBy("target", "node").agg(F.array_sort(F.collect_list(F.struct("feature", "c.gain", "c.threshold"))).alias("f"))
    first = F.aggregate(F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))), F.col("f")[0], lambda a, b: F.when(b["gain"] > a["gain"] + CLOSE, b).otherwise(a))
    return listed.select("target", "node", first.alias("b")).select("target", "node", "b.feature", "b.threshold")


def grow(df: DataFrame, columns: list[str], depth: int, leaf: list[int]) -> tuple[Trees, DataFrame]:
    """(trees, rows): a regression tree for each column from all others, and the rows (v: the columns' values, nodes: the
    leaf of each target). df holds numbers without nulls; leaf: the least rows of a leaf, for each target.

    What the driver gets are splits: at most 2^depth - 1 for each column."""
    rows = saved(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    got = rows.agg(*[F.percentile_approx(F.get("v", F.lit(i)), shares, 1000).alias(f"c{i}") for i in range(len(columns))]).first() if shares else None
    cuts = [sorted(set(got[f"c{i}"] or [])) if got else [] for i in range(len(columns))]
    trees: Trees = [{} for _ in columns]
    rows = rows.withColumn("nodes", F.array_repeat(F.lit(1), len(columns)))
    open_ = [[1] for _ in columns]
    for _ in range(depth):
        if not any(open_):
            break
        fresh: Trees = [{} for _ in columns]
        for r in _best(rows, open_, leaf, cuts).collect():
            fresh[r.target][r.node] = Split(r.feature, r.threshold)
        for tree, more in zip(trees, fresh, strict=True):
            tree.update(more)
        rows = rows.withColumn("nodes", _next_nodes(fresh))
        open_ = [[child for k in more for child in (2 * k, 2 * k + 1)] for more in fresh]
    return trees, rows


def path(tree: dict[int, Split], node: int) -> list[tuple[int, str, float]]:
    """The conditions (feature, operator, threshold) that lead to a node."""
    out = []
    while node > 1:
        s = tree[node // 2]
        out.append((s.feature, ">" if node % 2 else "<=", s.threshold))
        node //= 2
    return out[::-1]
