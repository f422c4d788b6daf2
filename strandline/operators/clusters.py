"""k-means of several k from several starts in shared scans, and silhouettes of all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that starts are drawn from and that silhouettes are measured against: a seeded sample.
SAMPLE_ROWS = 1000


def sample_of(rows: DataFrame, key: str, features: str, seed: int, n: int = SAMPLE_ROWS) -> pd.DataFrame:
    """(key, features) of the n rows that come first by a seeded hash of their key; all of a smaller table."""
    return rows.select(key, features).orderBy(F.xxhash64(F.lit(seed), key), key, features).limit(n).toPandas()


def _spread_out(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres: each next one is drawn by its squared distance to those before (k-means++)."""
    centres = [points[rng.integers(len(points))]]
    for _ in range(k - 1):
        d = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        total = d.sum()
        centres.append(points[rng.choice(len(points), p=d / total)] if total > 0 else points[rng.integers(len(points))])
    return np.array(centres)


def _settled(points: np.ndarray, centres: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Centres after k-means over the sample alone, from where few scans of all rows are left to do."""
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def _scan(rows: DataFrame, features: str, models: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
    """(rows, squared distances, sum) of every cluster of every model, from one scan; a task sends one row a cluster."""

    names, every = list(models), np.concatenate(list(models.values()))
    first = np.cumsum([0, *[len(c) for c in models.values()]])

    def sums(batches):
        n, e, s = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros(every.shape)
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                x = b.column(0).slice(at, 1 << 12).flatten().to_numpy().reshape(-1, every.shape[1])
                d = (x * x).sum(1)[:, None] - 2 * x @ every.T + (every * every).sum(1)[None]
                mine = np.zeros(d.shape)
                for a, z in zip(first, first[1:]):
                    near, i = a + d[:, a:z].argmin(1), np.arange(len(x))
                    mine[i, near] = 1
                    n += np.bincount(near, minlength=len(every))
                    e += np.bincount(near, np.maximum(d[i, near], 0), len(every))
                s += mine.T @ x
        place = np.flatnonzero(n)
        m = np.searchsorted(first, place, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)[m]), pa.array((place - first[m]).astype(np.int32)), pa.array(n[place]), pa.array(e[place]), pa.array(list(s[place]), pa.list_(pa.float64()))], ["m", "c", "n", "e", "s"])

    parts = rows.select(features).mapInArrow(sums, "m int, c int, n bigint, e double, s array<double>")
    width = len(next(iter(models.values()))[0])
    total = parts.groupBy("m", "c").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)])
    return {(r.m, r.c): (r.n, r.e, np.array([r[f"s{i}"] for i in range(width)])) for r in total.collect()}


def kmeans(rows: DataFrame, features: str, ks: list[int], sample: np.ndarray, starts: int = 10, seed: int = 42, rounds: int = 50, close: float = 1e-4) -> dict[int, np.ndarray]:
    """Centres for each k: of several starts those with the least sum of squared distances. All models of all k move on in
    the same scan, and each leaves when its centres hardly move (by their squared distances); what reaches the driver are
    sums of clusters. Starts are settled over the sample first."""
    rng = np.random.default_rng(seed)
    models = {i: _settled(sample, _spread_out(sample, k, rng)) for i, k in enumerate(k for k in ks for _ in range(starts))}
    # starts that settled alike would move alike: the first stands for them
    alike: dict[bytes, int] = {}
    for m, c in models.items():
        alike.setdefault(c[np.lexsort(c.T)].tobytes(), m)
    models = {m: models[m] for m in alike.values()}
    moving, error = set(models), {}
    for _ in range(rounds):
        if not moving:
            break
        found = _scan(rows, features, {m: models[m] for m in moving})
        for m in list(moving):
            mine = {c: v for (i, c), v in found.items() if i == m}
            error[m] = sum(e for _, e, _ in mine.values())
            # an empty cluster stays where it is
            new = np.array([mine[c][2] / mine[c][0] if c in mine else models[m][c] for c in range(len(models[m]))])
            if ((new - models[m]) ** 2).sum() <= close:
                moving.discard(m)
            models[m] = new
    best: dict[int, int] = {}
    for m, centres in models.items():
        k = len(centres)
        if k not in best or error[m] < error[best[k]]:
            best[k] = m
    return {k: models[m] for k, m in best.items()}


def labelled(rows: DataFrame, features: str, centres: np.ndarray, name: str = "prediction") -> DataFrame:
    """rows with the number of the nearest centre (the first on a tie)."""
    squared = [sum((F.get(features, F.lit(i)) - float(v)) ** 2 for i, v in enumerate(c)) for c in centres]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(squared)]))
    return rows.withColumn(name, nearest["i"])


def silhouettes(rows: DataFrame, key: str, features: str, label: str, sample: pd.DataFrame, labels: np.ndarray) -> dict[int, float]:
    """Mean Euclidean silhouette of each label over all rows: distances to each cluster are means over the sample's members
    of it (a row that is in the sample leaves itself out), so the cost is rows times sample. Exact where the sample has all
    rows. Labels that the sample doesn't have are left out."""
    points, kinds = np.stack(sample[features].to_numpy()), np.unique(labels)
    if len(kinds) < 2:
        return {}
    size = np.array([(labels == k).sum() for k in kinds])
    member = (labels[:, None] == kinds[None]).astype(float)
    known = set(sample[key])

    def means(batches):
        for b in batches:
            b = b[b[label].isin(kinds)]
            if not len(b):
                continue
            x = np.stack(b[features].to_numpy())
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ points.T + (points * points).sum(1)[None], 0))
            sums, own, i = d @ member, np.searchsorted(kinds, b[label].to_numpy()), np.arange(len(x))
            inside = b[key].isin(known).to_numpy()
            n = size[own] - inside
            a = sums[i, own] / np.maximum(n, 1)
            other = sums / size
            other[i, own] = np.inf
            rest = other.min(1)
            s = np.where(n > 0, (rest - a) / np.maximum(np.maximum(a, rest), 1e-300), 0.0)
            yield pd.DataFrame({"k": b[label].to_numpy(), "s": s})

    got = rows.select(key, features, label).mapInPandas(means, "k int, s double").groupBy("k").agg(F.avg("s").alias("s"))
    return {r.k: r.s for r in got.collect()}
