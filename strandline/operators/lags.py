"""Lagged kernels over series of any length: triggers and Granger tests.

Complete rows of each pair are numbered in order of time and dealt into blocks of rows; what blocks give are sums. No task
gets a whole series.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.tails import f_upper
from strandline.operators.ordered import BLOCK_ROWS, numbered
from strandline.operators.seams import Seams, over_blocks, seams
from strandline.operators.tables import saved
from strandline.schema import DiscoverySettings

#: Multiplier and modulus of the sequence that deals out the starts of baseline windows: fixed values.
_STRIDE, _CYCLE = 2_654_435_761, 1 << 32


def series_pairs(df: DataFrame, ts: str, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(pair, a, b, t, x, y): the rows of each pair of columns, from one scan of the matrix whatever the number of pairs.
    Names may hold any character; a pair is named by both, as JSON."""
    wanted = list(pairs) if pairs is not None else list(combinations(columns, 2))
    names = list(dict.fromkeys(c for p in wanted for c in p))
    at = {c: i for i, c in enumerate(names)}
    listed = F.from_json(F.lit(json.dumps([[at[a], at[b]] for a, b in wanted])), "array<array<int>>")
    values = F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")
    known = F.from_json(F.lit(json.dumps(names)), "array<string>")
    long = df.select(F.col(ts).cast("double").alias("t"), values.alias("v"), F.explode(listed).alias("p"))
    a, b = F.get(known, F.col("p")[0]), F.get(known, F.col("p")[1])
    return long.select(F.to_json(F.array(a, b)).alias("pair"), a.alias("a"), b.alias("b"), "t", F.get("v", F.col("p")[0]).alias("x"), F.get("v", F.col("p")[1]).alias("y"))


def complete(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without nulls, numbered by `_row` in order of t; a row a pair: n, coverage, means and spreads of both)."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    values = {c: F.when(both, F.col(c)) for c in "xy"}
    about = long.groupBy("pair", "a", "b").agg(F.count_if(both).alias("n"), F.avg(both.cast("double")).alias("coverage"), *[F.avg(v).alias(f"m{c}") for c, v in values.items()], *[F.stddev_pop(v).alias(f"s{c}") for c, v in values.items()])
    return numbered(long.filter(both).select("pair", "t", "x", "y"), "t", ["x", "y"], ["pair"]), about


# --- triggers ------------------------------------------------------------------------------------------------------


def trigger_scores(df: DataFrame, ts: str, pairs: list[tuple[str, str]], s: DiscoverySettings | None = None, seamed: Seams | None = None) -> DataFrame:
    """(source, target, n, coverage, jumps, response, baseline, ratio, confidence) for both directions of each pair: how much
    larger the target's steps are in the max_lag steps behind a jump of the source than elsewhere.

    A jump is a step above jump_z standard deviations of the source's steps. The baseline are windows of the same length,
    three for each jump; their starts follow from the jump's row number and the seed by a fixed sequence and are sent to
    the blocks that hold them. Directions with too few jumps or steps have no row. seamed: seams() of the same arguments."""
    s = s or DiscoverySettings()
    seamed = seamed or seams(df, ts, pairs, s.max_lag)
    totals, leads = seamed.totals, seamed.leads

    def sizes(m: int) -> int:
        """Steps of a window; 0 where there are too few steps."""
        lag = min(s.max_lag, (m + 1) // 4)
        return lag if lag >= 1 and m - lag >= 3 else 0

    def sides(p: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        dx, dy = np.abs(np.diff(x)), np.abs(np.diff(y))
        return [(True, dx, totals[p]["sdx"], dy), (False, dy, totals[p]["sdy"], dx)]

    def responses(p, lead, before, own, x, y, asked):
        m = totals[p]["n"] - 1
        if not (lag := sizes(m)):
            return []
        out, first = [], lead - before
        for forward, size, sd, target in sides(p, x, y):
            # the step that ends at an own row
            mine = np.arange(max(before, 1), before + own) - 1
            jumps = mine[size[mine] / (sd + 1e-10) > s.jump_z] if sd > 0 else mine[:0]
            if not len(jumps):
                continue
            sums, i = np.concatenate([[0.0], np.cumsum(target)]), jumps + first
            start, end = i + 1, np.minimum(i + 1 + lag, m)
            some = start < end
            means = (sums[end[some] - first] - sums[start[some] - first]) / (end - start)[some]
            out.append((p, None, forward, len(jumps), float(means.sum()), int(some.sum()), None))
            turn = (3 * i.astype(np.uint64)[:, None] + np.arange(1, 4, dtype=np.uint64)) * np.uint64(_STRIDE) + np.uint64(s.seed % _CYCLE)
            starts = np.sort((turn % np.uint64(_CYCLE) * np.uint64(m - lag) >> np.uint64(32)).astype(np.int64).ravel())
            to = np.searchsorted(leads[p][1], starts, "right") - 1
            for k in np.unique(to):
                out.append((p, int(leads[p][0][k]), forward, None, None, None, starts[to == k]))
        return out

    def baselines(p, lead, before, own, x, y, asked):
        out, lag, first = [], sizes(totals[p]["n"] - 1), lead - before
        for forward, _, _, target in sides(p, x, y):
            starts = [w for f, w in asked if f == forward]
            if starts:
                at, sums = np.concatenate(starts) - first, np.concatenate([[0.0], np.cumsum(target)])
                out.append((p, forward, float(((sums[at + lag] - sums[at]) / lag).sum()), len(at)))
        return out

    got = saved(over_blocks(seamed, responses, "pair int, _block int, forward boolean, jumps bigint, v double, c bigint, starts array<bigint>"))
    asked = got.filter("starts IS NOT NULL").select("pair", "_block", "forward", "starts")
    base = over_blocks(seamed, baselines, "pair int, forward boolean, v double, c bigint", asked)
    mean = lambda kind: F.try_divide(F.sum(F.when(F.col("kind") == kind, F.col("v"))), F.sum(F.when(F.col("kind") == kind, F.col("c")))).alias(kind)
    sums = got.filter("starts IS NULL").select("pair", "forward", "jumps", "v", "c", F.lit("response").alias("kind"))
    sums = sums.unionByName(base.withColumn("jumps", F.lit(0).cast("bigint")).withColumn("kind", F.lit("baseline")))
    score = sums.groupBy("pair", "forward").agg(F.sum("jumps").alias("jumps"), mean("response"), mean("baseline")).filter(F.col("jumps") >= s.min_jumps)
    score = score.filter("response IS NOT NULL AND baseline IS NOT NULL").withColumn("ratio", F.col("response") / (F.col("baseline") + 1e-10))
    out = score.join(seamed.known(), F.col("pair") == F.col("_p"))
    ends = [F.when(F.col("forward"), F.col(u)).otherwise(F.col(v)).alias(name) for name, u, v in (("source", "a", "b"), ("target", "b", "a"))]
    confidence = F.least(F.lit(0.85), F.greatest(F.lit(0.0), (F.col("ratio") - 1) / 3))
    return out.select(*ends, "n", "coverage", "jumps", "response", "baseline", "ratio", confidence.alias("confidence"))


# --- Granger tests -------------------------------------------------------------------------------------------------


def lagged_grams(df: DataFrame, ts: str, pairs: list[tuple[str, str]], max_lag: int, rows: int = BLOCK_ROWS) -> tuple[DataFrame, Seams]:
    """((pair, p, at, v), blocks and totals): sums of products of all columns 1, y, x, the p values of y before and those of x,
    standardised, over the rows that have p rows before them, flattened row by row; v is the value at place `at`.

    Products over rows with max_lag rows before them serve all p (as p = 0, for max_lag); the few rows at a series' start are
    added for each p. One pass over blocks of rows gives one matrix a block and pair."""
    seamed = seams(df, ts, pairs, max_lag, rows)
    totals = seamed.totals

    def design(x: np.ndarray, y: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
        return np.stack([np.ones(len(at)), y[at], x[at], *[y[at - k] for k in range(1, p + 1)], *[x[at - k] for k in range(1, p + 1)]], 1)

    def sums(pair, lead, before, own, x, y, asked):
        known = totals[pair]
        if not (known["sx"] > 0 and known["sy"] > 0):
            return []
        x, y = (x - known["mx"]) / known["sx"], (y - known["my"]) / known["sy"]
        place = np.arange(before, before + own)
        row, out = place - before + lead, []
        for p in range(max_lag + 1):
            at = place[row >= max_lag] if not p else place[(row >= p) & (row < max_lag)]
            if len(at):
                m = design(x, y, at, p or max_lag)
                out += [(pair, p, i, v) for i, v in enumerate((m.T @ m).ravel())]
        return out

    parts = over_blocks(seamed, sums, "pair int, p int, at int, v double")
    return parts.groupBy("pair", "p", "at").agg(F.sum("v").alias("v")), seamed


def _unexplained(g: np.ndarray, target: int, by: list[int]) -> float:
    """Residual sum of squares of a regression, from its sums of products."""
    a, b = g[np.ix_(by, by)], g[by, target]
    try:
        half = np.linalg.solve(np.linalg.cholesky(a), b)
        return float(g[target, target] - half @ half)
    except np.linalg.LinAlgError:  # columns that depend on each other
        return float(g[target, target] - b @ np.linalg.lstsq(a, b, rcond=None)[0])


def granger_of(grams: dict[int, np.ndarray], n: int, max_lag: int, forward: bool) -> tuple[float, int] | None:
    """(p, lag) of the lag at which the source's past helps most to predict the target (the first on a tie), by F tests of
    nested regressions. grams: the flattened sums of lagged_grams(). forward: does x lead y?"""
    best = None
    whole = grams.get(0, np.zeros((2 * max_lag + 3) ** 2)).reshape(2 * max_lag + 3, -1)
    for p in range(1, min(max_lag, n // 6) + 1):
        df = n - 3 * p - 1
        if df <= 0:
            break
        # columns of lag p in the matrix of max_lag
        pick = [0, 1, 2, *range(3, 3 + p), *range(3 + max_lag, 3 + max_lag + p)]
        g = whole[np.ix_(pick, pick)] + (grams[p].reshape(2 * p + 3, -1) if p in grams else 0.0)
        own, other = list(range(3, 3 + p)), list(range(3 + p, 3 + 2 * p))
        target, own, other = (1, own, other) if forward else (2, other, own)
        less, full = _unexplained(g, target, [0, *own]), _unexplained(g, target, [0, *own, *other])
        if full <= 0:
            continue
        value = f_upper(max(0.0, (less - full) / p / (full / df)), p, df)
        if best is None or value < best[0]:
            best = (value, p)
    return best


def granger_tests(df: DataFrame, ts: str, pairs: list[tuple[str, str]], max_lag: int, least: int = 30, rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, target, n, coverage, p, lag) for both directions of each pair with at least `least` complete rows and no
    constant column. A pair's task gets sums of products alone: a few thousand numbers, whatever the length of its series."""
    grams, seamed = lagged_grams(df, ts, pairs, max_lag, rows)
    ok = [p for p, t in seamed.totals.items() if t["n"] >= least and t["sx"] > 1e-10 and t["sy"] > 1e-10]
    both = grams.join(seamed.known().filter(F.col("_p").isin(ok)), F.col("pair") == F.col("_p")).drop("_p")

    def kernel(t: pd.DataFrame) -> pd.DataFrame:
        one = t.iloc[0]
        found = {int(p): g.sort_values("at").v.to_numpy(float) for p, g in t.groupby("p")}
        got = [(src, dst, granger_of(found, int(one.n), max_lag, forward)) for src, dst, forward in ((one.a, one.b, True), (one.b, one.a, False))]
        return pd.DataFrame([(src, dst, one.n, one.coverage, float(g[0]), int(g[1])) for src, dst, g in got if g], columns=["source", "target", "n", "coverage", "p", "lag"])

    return both.groupBy("pair").applyInPandas(kernel, "source string, target string, n bigint, coverage double, p double, lag int")


def unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
