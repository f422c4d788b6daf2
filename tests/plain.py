"""Kernels over whole series in numpy, which the distributed ones are held against."""

from __future__ import annotations

import numpy as np

from strandline.functions.tails import f_upper
from strandline.operators.dependence import ROUNDING, kth_distance


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Kraskov's first kNN estimator in nats; a tiny seeded noise breaks ties."""
    n = len(x)
    if n <= k + 1 or x.std() == 0 or y.std() == 0:
        return 0.0
    rng = np.random.default_rng(seed)
    x, y = ((v - v.mean()) / v.std() + 1e-10 * max(1, np.abs(v / v.std()).mean()) * rng.standard_normal(n) for v in (x, y))
    xs, ys = np.sort(x), np.sort(y)
    eps = kth_distance(x, y, k) - ROUNDING
    nx = np.searchsorted(xs, x + eps, "left") - np.searchsorted(xs, x - eps, "right")
    ny = np.searchsorted(ys, y + eps, "left") - np.searchsorted(ys, y - eps, "right")
    total = (_digamma(np.maximum(nx, 1)) + _digamma(np.maximum(ny, 1))).sum()
    return max(0.0, float(_digamma(np.array([k]))[0] + _digamma(np.array([n]))[0] - total / n))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def xcorr(x: np.ndarray, y: np.ndarray, lag: int) -> np.ndarray | None:
    """Cross-correlation at lags -lag..lag: mean of z_y[t + k] z_x[t] over all n rows; None if either is constant."""
    n = len(x)
    if x.std() == 0 or y.std() == 0:
        return None
    zx, zy = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(zy, size) * np.conj(np.fft.rfft(zx, size)), size) / n
    return np.concatenate([c[-lag:], c[: lag + 1]]) if lag else c[:1]


def granger(x: np.ndarray, y: np.ndarray, max_lag: int) -> tuple[float, int] | None:
    """(p, lag) of the lag at which x's past helps most to predict y (first on a tie): F test of nested regressions."""
    n = len(x)
    best = None
    for p in range(1, min(max_lag, n // 6) + 1):
        t = n - p
        own = np.stack([np.ones(t), *[y[p - i - 1 : n - i - 1] for i in range(p)]], 1)
        both = np.concatenate([own, np.stack([x[p - i - 1 : n - i - 1] for i in range(p)], 1)], 1)
        df = t - 2 * p - 1
        if df <= 0:
            break
        rss = [float(np.square(y[p:] - m @ np.linalg.lstsq(m, y[p:], rcond=None)[0]).sum()) for m in (own, both)]
        if rss[1] <= 0:
            continue
        pv = f_upper(max(0.0, (rss[0] - rss[1]) / p / (rss[1] / df)), p, df)
        if best is None or pv < best[0]:
            best = (pv, p)
    return best


def best_split(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the split that lowers squared error most; thresholds are midpoints."""
    best, n = None, len(y)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        s, total = np.cumsum(t)[:-1], t.sum()
        k = np.arange(1, n)
        gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
        gain[(v[1:] == v[:-1]) | (k < leaf) | (n - k < leaf)] = -np.inf
        if len(gain) and (i := int(np.argmax(gain))) >= 0 and np.isfinite(gain[i]) and gain[i] > 1e-12 and (best is None or gain[i] > best[0] + 1e-12):
            best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    return best


def tree_leaves(x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> list[tuple[list[tuple[int, str, float]], np.ndarray]]:
    """(conditions, rows) of each leaf of a regression tree."""
    out, todo = [], [([], np.arange(len(y)))]
    while todo:
        path, rows = todo.pop()
        split = best_split(x[rows], y[rows], leaf) if len(path) < depth and len(rows) >= 2 * leaf else None
        if split is None:
            out.append((path, rows))
            continue
        _, j, t = split
        low = x[rows, j] <= t
        todo += [([*path, (j, ">", t)], rows[~low]), ([*path, (j, "<=", t)], rows[low])]
    return out




def chains(edges: dict, most: int = 12, length: int = 4) -> list[tuple[list[str], float]]:
    """Every simple path is made, sorted and then thinned."""
    nodes = sorted({n for e in edges for n in e})
    targets, sources = {b for _, b in edges}, {a for a, _ in edges}
    starts = [n for n in nodes if n not in targets] or nodes
    leaves = [n for n in nodes if n not in sources] or nodes
    found, todo = [], [[n] for n in starts]
    while todo:
        path = todo.pop()
        if len(path) > 1 and path[-1] in leaves:
            found.append((path, min(edges[p]["confidence"] for p in zip(path, path[1:]))))
        if len(path) <= length:
            todo += [[*path, n] for n in nodes if (path[-1], n) in edges and n not in path]
    found.sort(key=lambda c: (-len(c[0]), -c[1], c[0]))
    kept: list = []
    for path, confidence in found:
        n = len(path)
        if not any(path == k[i : i + n] for k, _ in kept for i in range(len(k) - n + 1)):
            kept.append((path, confidence))
    return kept[:most]
