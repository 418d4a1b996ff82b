"""Quantiles of the chi-squared distribution."""

from __future__ import annotations

import math


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    # Continued fraction of the upper part, evaluated from the front.
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1.0 - front * h


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, max(1.0, float(dof))
    while _lower_gamma(dof / 2, high / 2) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _lower_gamma(dof / 2, mid / 2) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2
