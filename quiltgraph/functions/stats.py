"""Binomial confidence bounds without scipy."""

from __future__ import annotations

from math import exp, lgamma, log, log1p


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * exp(a * log(x) + b * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a


def quantile(a: float, b: float, p: float) -> float:
    """The beta distribution's quantile, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(trials: int, successes: int, alpha: float = 0.05) -> tuple[float, float]:
    """Bounds of the success probability at confidence ``1 - alpha``."""
    low = 0.0 if successes == 0 else quantile(successes, trials - successes + 1, alpha / 2)
    high = 1.0 if successes == trials else quantile(successes + 1, trials - successes, 1 - alpha / 2)
    return low, high


def settled(trials: int, successes: int) -> bool:
    """Whether the bounds lie within 0.8 and 1.25 times the observed rate."""
    if not successes:
        return False
    rate, (low, high) = successes / trials, clopper_pearson(trials, successes)
    return 0.8 * rate < low and high < 1.25 * rate
