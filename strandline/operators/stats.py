"""Pairwise statistics of a state matrix: correlation, mutual information, lags, triggers and Granger tests.

Sums over pairs take one scan of a matrix, whatever the number of its columns. Kernels over series
(ranks, neighbours, lags) work on ranges of values and blocks of rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from strandline.functions.tails import pearson_p
from strandline.operators.dependence import mutual_informations
from strandline.operators.lags import granger_tests, trigger_scores
from strandline.operators.ordered import range_of
from strandline.operators.seams import Seams, over_blocks, seams
from strandline.schema import DiscoverySettings

#: Pairs of columns in one aggregate; more would outgrow generated code, and go by sums of products.
PAIRS_AT_ONCE = 60


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "OBSERVED").when(confidence >= 0.45, "PROBABLE").otherwise("SPECULATIVE")


def level_of(confidence: float) -> str:
    return "OBSERVED" if confidence >= 0.7 else "PROBABLE" if confidence >= 0.45 else "SPECULATIVE"


def numeric_columns(df: DataFrame, columns: list[str] | None = None, share: float = 0.8) -> list[str]:
    """Columns of which at least this share of the non-null values are numbers, or that are all null. One scan."""
    columns = columns or df.columns
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count(F.col(c).try_cast("double")).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] == 0 or row[f"k{i}"] >= share * row[f"n{i}"]]


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rows, n, r): for each pair of columns all rows, complete rows and Pearson's r (null if either is constant).

    One scan, whatever the number of columns: few pairs are aggregates of their own, many are sums of products of blocks of
    rows, see gram_moments()."""
    pairs = list(combinations(columns, 2))
    if len(pairs) > PAIRS_AT_ONCE:
        return gram_moments(df, columns)
    aggs = [F.count("*").alias("rows")]
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        # merged spreads of a constant are not exactly 0
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs += [F.count_if(both).alias(f"n{i}"), F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"r{i}")]
    found = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("rows"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    if not found:
        return df.sparkSession.createDataFrame([], "a string, b string, rows bigint, n bigint, r double")
    return df.agg(*aggs).select(F.inline(F.array(*found)))


def gram_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """pair_moments() of many columns from one matrix product for each batch of rows: with X the values (0 where null) less a
    constant near each column's mean, and M where they are known, M'M, X'M, (X^2)'M and X'X hold all that a pair's complete
    rows need. A task sends a row for each column once, so what travels is tasks times columns squared."""
    m = len(columns)
    numbers = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    near = numbers.limit(1000).agg(*[F.avg(f"c{i}") for i in range(m)]).first()
    centre = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in near])

    def sums(batches):
        total = np.zeros((4, m, m))
        rows = 0
        for t in batches:
            x = t.to_numpy(float) - centre
            known = ~np.isnan(x)
            x, k = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([k.T @ k, x.T @ k, (x * x).T @ k, x.T @ x])
            rows += len(x)
        if rows:
            yield pd.DataFrame({"i": np.arange(m), "rows": rows, "v": [total[:, i].ravel() for i in range(m)]})

    parts = numbers.mapInPandas(sums, "i int, rows bigint, v array<double>")
    at = parts.select("i", "rows", F.posexplode("v").alias("at", "v")).groupBy("i", "at").agg(F.sum("rows").alias("rows"), F.sum("v").alias("v"))
    kind = (F.col("at") / m).cast("int")
    cell = at.select("i", (F.col("at") % m).alias("j"), kind.alias("kind"), "rows", "v")
    sides = cell.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("i") < F.col("j"), "kind", "rows", "v").toDF("i", "j", "up", "kind", "rows", "v").filter("i < j")
    of = lambda k, up: F.max(F.when((F.col("kind") == k) & (F.col("up") == up), F.col("v")))
    s = sides.groupBy("i", "j").agg(F.max("rows").alias("rows"), of(0, True).alias("n"), of(1, True).alias("sx"), of(1, False).alias("sy"), of(2, True).alias("sxx"), of(2, False).alias("syy"), of(3, True).alias("sxy"))
    n = F.col("n")
    spread = lambda q, x, y: q - F.try_divide(x * y, n)
    vx, vy = spread(F.col("sxx"), F.col("sx"), F.col("sx")), spread(F.col("syy"), F.col("sy"), F.col("sy"))
    # what is left of a constant's sums is rounding
    flat = (vx <= 1e-12 * F.col("sxx")) | (vy <= 1e-12 * F.col("syy"))
    r = F.when(~flat, F.try_divide(spread(F.col("sxy"), F.col("sx"), F.col("sy")), F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in columns])
    return s.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "rows", n.cast("bigint").alias("n"), r.alias("r"))


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (numbers without nulls) with each column replaced by its average ranks.

    A column's distinct values are counted and run through in ranges; what is before a range comes from one row a range."""
    # counts of every column come from the rows as they were given, not from those that earlier columns were joined to
    base = df
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [k / n for k in range(1, n)]
    cuts = df.agg(*[F.percentile_approx(c, at, 1000).alias(f"c{i}") for i, c in enumerate(columns)]).first() if at else None
    for i, c in enumerate(columns):
        values = base.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_r", range_of(F.col("_v"), sorted(set(cuts[i] or [])) if cuts else []))
        before = values.groupBy(F.col("_r").alias("_q")).agg(F.sum("_n").alias("_n"))
        before = before.select("_q", F.coalesce(F.sum("_n").over(W.Window.orderBy("_q").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_lead"))
        upto = F.sum("_n").over(W.Window.partitionBy("_r").orderBy("_v"))
        values = values.withColumn("_upto", upto).join(before, F.col("_r") == F.col("_q"))
        values = values.select("_v", (F.col("_lead") + F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias("_rank"))
        df = df.join(values, F.col(c) == F.col("_v")).withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return df


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho). Each column is ranked once, and all pairs are correlated in one scan; pairs with nulls are ranked
    over their complete rows, see pair_ranks()."""
    d = df.select([F.col(c).cast("double").alias(c) for c in columns])
    filled = d.agg(F.count("*").alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    whole = [c for i, c in enumerate(columns) if filled[f"k{i}"] == filled["n"]]
    out = []
    if len(whole) > 1:
        out.append(pair_moments(ranked(d.select(whole), whole), whole).select("a", "b", "n", F.col("r").alias("rho")))
    rest = [(a, b) for a, b in combinations(columns, 2) if a not in whole or b not in whole]
    for at in range(0, len(rest), PAIRS_AT_ONCE):
        out.append(pair_ranks(d, rest[at : at + PAIRS_AT_ONCE]))
    return reduce(DataFrame.unionByName, out) if out else pair_moments(d.limit(0), columns)


def pair_ranks(d: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, n, rho) of a few pairs of columns (numbers), each ranked over its own complete rows. A column's values are counted
    once for all of its pairs, and its ranks in all of them are joined at once; one scan correlates all pairs."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    others = {c: [b if c == a else a for a, b in pairs if c in (a, b)] for c in columns}
    at = {c: i for i, c in enumerate(columns)}
    base = d.select([F.col(c).alias(f"c{i}") for c, i in at.items()])
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    cuts = base.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in base.columns]).first() if shares else None
    rows = base
    for c, i in at.items():
        ks = range(len(others[c]))
        values = base.filter(F.col(f"c{i}").isNotNull()).groupBy(F.col(f"c{i}").alias("_v")).agg(*[F.count(f"c{at[o]}").alias(f"_n{k}") for k, o in enumerate(others[c])])
        values = values.withColumn("_r", range_of(F.col("_v"), sorted(set(cuts[f"c{i}"] or [])) if cuts else []))
        before = values.groupBy(F.col("_r").alias("_q")).agg(*[F.sum(f"_n{k}").alias(f"_n{k}") for k in ks])
        w = W.Window.orderBy("_q").rowsBetween(W.Window.unboundedPreceding, -1)
        before = before.select("_q", *[F.coalesce(F.sum(f"_n{k}").over(w), F.lit(0)).alias(f"_lead{k}") for k in ks])
        upto = W.Window.partitionBy("_r").orderBy("_v")
        values = values.select("*", *[F.sum(f"_n{k}").over(upto).alias(f"_upto{k}") for k in ks]).join(before, F.col("_r") == F.col("_q"))
        values = values.select("_v", F.array(*[F.col(f"_lead{k}") + F.col(f"_upto{k}") - (F.col(f"_n{k}") - 1) / F.lit(2.0) for k in ks]).alias(f"r{i}"))
        rows = rows.join(values, F.col(f"c{i}") == F.col("_v"), "left").drop("_v")
    aggs, found = [], []
    for p, (a, b) in enumerate(pairs):
        both = F.col(f"c{at[a]}").isNotNull() & F.col(f"c{at[b]}").isNotNull()
        x, y = (F.when(both, F.get(f"r{at[c]}", F.lit(others[c].index(o)))) for c, o in ((a, b), (b, a)))
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggs += [F.count_if(both).alias(f"n{p}"), F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"rho{p}")]
        found.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{p}").alias("n"), F.col(f"rho{p}").alias("rho")))
    return rows.agg(*aggs).select(F.inline(F.array(*found)))


def r_confidence(r: float, n: int) -> float:
    return float(np.clip(abs(r) * (0.7 + 0.3 * min(1.0, n / 100)), 0, 1))


def cross_correlations(df: DataFrame, ts: str, pairs: list[tuple[str, str]], lag: int, seamed: Seams | None = None) -> DataFrame:
    """(a, b, n, coverage, lag, r): r = sum of z_b[t + lag] z_a[t] / n over the complete rows of each pair, taken as one
    series, for lags -lag..lag; null where either column is constant.

    The matrix goes in blocks of rows, which get `lag` rows of each pair at their borders, so a series of any length is many
    tasks; what they give is a sum for each lag. seamed: seams() of the same arguments."""
    seamed = seamed or seams(df, ts, pairs, lag)
    totals = seamed.totals

    def sums(p, lead, before, own, x, y, asked):
        t, last = totals[p], before + own
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = (np.full(len(v), np.nan) if t[f"s{c}"] == 0 else (v - t[f"m{c}"]) / t[f"s{c}"] for c, v in (("x", x), ("y", y)))
        got = []
        for k in range(-lag, lag + 1):
            i, j = max(before, -k), min(last, len(y) - k)
            got.append((p, k, float(x[i:j] @ y[i + k : j + k]) if j > i else 0.0))
        return got

    parts = over_blocks(seamed, sums, "pair int, lag bigint, p double").groupBy("pair", "lag").agg(F.sum("p").alias("p"))
    out = parts.join(seamed.known(), F.col("pair") == F.col("_p"))
    r = F.col("p") / F.col("n")
    return out.select("a", "b", "n", "coverage", "lag", F.when(~F.isnan(r), r).alias("r"))


FINDING = "a string, b string, metric string, value double, p double, coverage double, confidence double, n bigint"
RELATION = "source string, target string, type string, confidence double, lag double, lag_confidence double, p double, coverage double, method string, value double, best_lag double"


def correlations(df: DataFrame, ts: str, columns: list[str], s: DiscoverySettings | None = None) -> list[dict]:
    """Findings of Pearson, Spearman and mutual information: small, a few for each pair."""
    s = s or DiscoverySettings()
    out = []
    seen = {}
    for r in pair_moments(df, columns).collect() if len(columns) > 1 else []:
        cover = r.n / r.rows if r.rows else 0.0
        if cover >= s.min_coverage and r.n >= 10:
            seen[r.a, r.b] = (cover, r.n)
            if r.r is not None and abs(r.r) >= s.pearson_min and (p := pearson_p(r.r, r.n)) <= s.p_max:
                out.append({"a": r.a, "b": r.b, "metric": "pearson", "value": r.r, "p": p, "coverage": cover, "confidence": r_confidence(r.r, r.n), "n": r.n})
    if not seen:
        return out
    for r in spearman(df, columns).collect():
        if (r.a, r.b) in seen and r.rho is not None and abs(r.rho) >= s.spearman_min and (p := pearson_p(r.rho, r.n)) <= s.p_max:
            out.append({"a": r.a, "b": r.b, "metric": "spearman", "value": r.rho, "p": p, "coverage": seen[r.a, r.b][0], "confidence": r_confidence(r.rho, r.n), "n": r.n})

    for r in mutual_informations(df, ts, list(seen), seed=s.seed).collect():
        if r.mi >= s.mi_min:
            out.append({"a": r.a, "b": r.b, "metric": "mutual_information", "value": r.mi, "p": None, "coverage": r.coverage, "confidence": float(np.clip(1.5 * r.mi / (r.mi + 1), 0, 1)), "n": r.n})
    return out


def lagged(df: DataFrame, ts: str, columns: list[str], s: DiscoverySettings | None = None) -> DataFrame:
    """Relations by cross-correlation (INFLUENCES) and by jumps (TRIGGERS), both from sums over blocks of rows."""
    s = s or DiscoverySettings()
    pairs = list(combinations(columns, 2))
    enough = (F.col("coverage") >= s.min_coverage) & (F.col("n") >= max(20, 2 * s.max_lag))
    seamed = seams(df, ts, pairs, s.max_lag)
    found = cross_correlations(df, ts, pairs, s.max_lag, seamed).filter(enough & F.col("r").isNotNull() & (F.abs("lag") <= F.floor(F.col("n") / 4)))
    # the first of the greatest peaks, and how far the others are below it
    by = found.groupBy("a", "b", "coverage").agg(F.max(F.struct(F.abs("r").alias("size"), (-F.col("lag")).alias("back"), "r")).alias("top"), F.sum(F.abs("r")).alias("total"), F.count("*").alias("m"))
    peak, k = F.col("top.size"), -F.col("top.back")
    rest = F.coalesce(F.try_divide(F.col("total") - peak, F.col("m") - 1), F.lit(0.0))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    ahead = k >= 0
    influences = by.filter(peak >= s.xcorr_min).select(
        F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("target"), F.lit("INFLUENCES").alias("type"),
        unit(peak).alias("confidence"), F.abs(k).cast("double").alias("lag"), unit(F.coalesce(F.try_divide(peak - rest, peak), F.lit(0.0))).alias("lag_confidence"),
        F.lit(None).cast("double").alias("p"), "coverage", F.lit("cross_correlation").alias("method"), F.col("top.r").alias("value"), F.lit(None).cast("double").alias("best_lag"),
    )

    found = trigger_scores(df, ts, pairs, s, seamed).filter((F.col("coverage") >= s.min_coverage) & (F.col("n") >= max(20, 2 * s.max_lag)) & (F.col("ratio") >= 1.5))
    none = F.lit(None).cast("double")
    triggers = found.select("source", "target", F.lit("TRIGGERS").alias("type"), "confidence", F.lit(0.0).alias("lag"), none.alias("lag_confidence"), none.alias("p"), "coverage", F.lit("trigger_detection").alias("method"), F.col("ratio").alias("value"), none.alias("best_lag"))
    return influences.unionByName(triggers)


def causes(df: DataFrame, ts: str, pairs: list[tuple[str, str]], s: DiscoverySettings | None = None) -> DataFrame:
    """Granger relations of pairs, both ways."""
    s = s or DiscoverySettings()
    found = granger_tests(df, ts, pairs, s.granger_lag, max(30, 3 * s.granger_lag)).filter(F.col("p") <= s.granger_p)
    lag = F.col("lag").cast("double")
    confidence = F.least(F.lit(0.95), F.greatest(F.lit(0.3), 1 - 10 * F.col("p")))
    return found.select("source", "target", F.lit("INFLUENCES").alias("type"), confidence.alias("confidence"), lag.alias("lag"), (1 - F.col("p")).alias("lag_confidence"), "p", "coverage", F.lit("granger_causality").alias("method"), F.col("p").alias("value"), lag.alias("best_lag"))
