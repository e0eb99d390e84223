"""Numeric kernels on numpy arrays: gamma, beta, Student t, Poisson, and exact rank distributions."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count

import numpy as np

# Lanczos coefficients for g = 7.
LANCZOS = np.array([0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    y = np.where(small, 1.0 - x, x) - 1.0
    series = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    found = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(series)
    with np.errstate(invalid="ignore", divide="ignore"):
        mirrored = np.log(np.pi / np.abs(np.sin(np.pi * x))) - found
    return np.where(small, mirrored, found)


def beta_fraction(p: np.ndarray, q: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, on flat arrays; values that stand leave the passes."""
    tiny = 1e-300
    found, place = np.empty(len(z)), np.arange(len(z))
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in count(1):
        for even in (True, False):
            step = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) if even else -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            h = h * change
        moving = np.abs(change - 1) > 1e-14
        left = np.count_nonzero(moving)
        if not left:
            found[place] = h
            return found
        if left < 0.75 * len(h):
            found[place[~moving]] = h[~moving]
            place, p, q, z, c, d, h = (x[moving] for x in (place, p, q, z, c, d, h))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast.

    The fraction needs about as many passes as the root of the larger parameter; it runs until all values stand."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    scale = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    x, a, b, scale = np.broadcast_arrays(np.asarray(x, float), a, b, scale)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    part = np.where(y <= 0, 0.0, 1.0)
    inside = (y > 0) & (y < 1)
    p, q, z = p[inside], q[inside], y[inside]
    if len(z):
        part[inside] = np.exp(scale[inside] + p * np.log(z) + q * np.log1p(-z)) * beta_fraction(p, q, z) / p
    return np.clip(np.where(turned, 1 - part, part), 0, 1)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p value of Student's t."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


def poisson_above(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X > k) of a Poisson variable: the regularised incomplete gamma function P(k + 1, mean).

    Below the mean of the gamma variable by its series, above it as 1 less the other tail's continued fraction; both begin
    with a factor that is taken in logarithms, so that means of millions neither vanish nor overflow.
    """
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    if not k.size:
        return np.zeros(k.shape)
    a, x = k + 1, np.maximum(mean, 1e-300)
    front = np.exp(a * np.log(x) - x - log_gamma(a))
    low = x < a + 1
    term = 1 / a
    series = term.copy()
    y = np.where(low, x, 0.0)
    for n in count(1):
        term = term * y / (a + n)
        series += term
        if np.all(term <= 1e-17 * series):
            break
    z = np.where(low, a + 2, x)
    b = z + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / b
    h = d.copy()
    for n in count(1):
        step = -n * (n - a)
        b = b + 2
        d = 1 / (step * d + b)
        c = b + step / c
        h = h * (c * d)
        if not np.any(np.abs(c * d - 1) > 1e-14):
            break
    return np.clip(np.where(low, front * series, 1 - front * h), 0, 1)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in np.ravel(z)]).reshape(np.shape(z))


@lru_cache(4096)
def u_counts(n: int, m: int) -> tuple[int, ...]:
    """How many orders of n and m values have each value of the U statistic."""
    ways = [1] + [0] * (n * m)
    for k in range(1, n + 1):  # product of (1 - x^(m + k)) / (1 - x^k)
        for i in range(n * m, m + k - 1, -1):
            ways[i] -= ways[i - m - k]
        for i in range(k, n * m + 1):
            ways[i] += ways[i - k]
    return tuple(ways)


def u_test(u: float, n: int, m: int, ties: list[int], exact_upto: int = 64) -> float:
    """Two-sided p of Mann-Whitney's U: exact for n + m up to `exact_upto`, else normal with corrections for continuity
    and for ties (the sum over all groups of equal values)."""
    if not n or not m:
        return 1.0
    u = min(u, n * m - u)
    if n + m <= exact_upto:
        return min(1.0, 2 * sum(u_counts(n, m)[: math.floor(u) + 1]) / math.comb(n + m, n))
    total = n + m
    spread = n * m / 12 * ((total + 1) - sum(t**3 - t for t in ties) / (total * (total - 1)))
    return 1.0 if spread <= 0 else float(normal_two_sided(np.array((abs(u - n * m / 2) - 0.5) / math.sqrt(spread))))


@lru_cache(4096)
def u_shares(n: int, m: int) -> np.ndarray:
    """P(U <= u) for u = 0, 1, ... when all orders are as likely."""
    whole, upto, found = math.comb(n + m, n), 0, []
    for ways in u_counts(n, m):
        upto += ways
        found.append(upto / whole)
    return np.array(found)


def u_tests(u: np.ndarray, n: int, m: int, ties: np.ndarray, exact_upto: int = 64) -> np.ndarray:
    """u_test of many values of U with equal n and m; ties: of each the sum of t^3 - t over its groups of equal values."""
    if not n or not m:
        return np.ones(len(u))
    u = np.minimum(u, n * m - u)
    if n + m <= exact_upto:
        return np.minimum(1.0, 2 * u_shares(n, m)[np.floor(u).astype(int)])
    total = n + m
    spread = n * m / 12 * ((total + 1) - ties / (total * (total - 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (np.abs(u - n * m / 2) - 0.5) / np.sqrt(spread)
    return np.where(spread <= 0, 1.0, normal_two_sided(np.where(spread <= 0, 0.0, z)))


@lru_cache(4096)
def split_counts(n: int, m: int, least: int) -> int:
    """Orders of n and m labels for which every threshold mislabels `least` or more.

    A threshold after i values of which a are of the first kind mislabels min(a + m - b, n - a + b) with b = i - a; orders
    are paths from (0, 0) to (n, m), those that stay where this is at least `least` are counted column by column.
    """
    ways = {0: 1}
    fits = lambda a, b: min(a + m - b, n - a + b) >= least
    if not fits(0, 0):
        return 0
    for i in range(1, n + m + 1):
        new: dict[int, int] = {}
        for a, w in ways.items():
            for x in (a, a + 1):
                b = i - x
                if x <= n and 0 <= b <= m and fits(x, b):
                    new[x] = new.get(x, 0) + w
        ways = new
    return ways.get(n, 0)


def tnom_p(score: int, n: int, m: int) -> float:
    """P(fewest mislabelled <= score) when all orders are as likely."""
    return 1.0 if not n or not m else 1 - split_counts(n, m, score + 1) / math.comb(n + m, n)


def entropy(a: float, b: float) -> float:
    """(a + b) times the entropy of the shares, in nats."""
    return -sum(x * math.log(x / (a + b)) for x in (a, b) if x > 0)


@lru_cache(4096)
def info_p(score: float, n: int, m: int) -> float:
    """P(least split entropy <= score) when all orders are as likely: paths that stay above the score at every split."""
    above = lambda a, b: entropy(a, b) + entropy(n - a, m - b) > score + 1e-9
    ways = {0: 1} if above(0, 0) else {}
    for i in range(1, n + m + 1):
        new: dict[int, int] = {}
        for a, w in ways.items():
            for x in (a, a + 1):
                if x <= n and 0 <= i - x <= m and above(x, i - x):
                    new[x] = new.get(x, 0) + w
        ways = new
    return 1 - ways.get(n, 0) / math.comb(n + m, n)
