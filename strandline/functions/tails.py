"""Tail probabilities of Student's t and Fisher's F by the incomplete beta function's continued fraction."""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def pearson_p(r: float, n: int) -> float:
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
