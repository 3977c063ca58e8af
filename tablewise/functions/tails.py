"""Tail probabilities for a handful of driver-side test statistics."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by Newton steps on erfc."""
    if p <= 0.0 or p >= 1.0:
        return math.copysign(math.inf, p - 0.5)
    x = 0.0
    lo, hi = -40.0, 40.0
    for _ in range(200):
        err = normal_cdf(x) - p
        if err > 0:
            hi = x
        else:
            lo = x
        dens = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = x - err / dens if dens > 1e-300 else math.inf
        nxt = step if lo < step < hi else (lo + hi) / 2
        if abs(nxt - x) < 1e-15 * max(1.0, abs(x)):
            return nxt
        x = nxt
    return x


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of chi-square: regularised incomplete gamma by series or continued fraction."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, y = dof / 2.0, x / 2.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = y + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if dof <= 0:
        return 1.0
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def correlation_p(r: float | None, n: int) -> float:
    """Two-sided p of a Pearson correlation over n pairs."""
    if r is None or n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def ks_sf(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p of the two-sample Kolmogorov-Smirnov distance."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    if x < 1.18:  # the theta form converges faster for small x
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 30))
        return min(1.0, max(0.0, 1.0 - math.sqrt(2 * math.pi) / x * s))
    s = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * s))
