"""P-values of the two-sample Kolmogorov-Smirnov statistic, on numbers: one call a feature.

Up to 10,000 values a side the probability is exact: the share of lattice paths that leave the band. Beyond, it is that of
the one-sample statistic of the effective size: exact for small statistics (powers of a matrix), twice the one-sided
probability in the tail, and the expansion of the distribution to the third order in between.
"""

from __future__ import annotations

import math

import numpy as np

EXACT_VALUES = 10_000  # of the larger side, at most
SUMMED = 1 << 20  # terms of the one-sided sum, at most; beyond, its limit is equal to a millionth part


def exact_two_sample(n: int, m: int, statistic: float) -> float:
    """The probability of a statistic as large, of n and m values without ties: paths from (0, 0) to (n, m), diagonal by
    diagonal, by the share of those to each point that have been outside."""
    g = math.gcd(n, m)
    lcm = n // g * m
    limit = round(statistic * lcm)
    if limit <= 0:
        return 1.0
    out = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        lo, hi = max(0, s - m), min(n, s)
        i = np.arange(lo, hi + 1)
        now = out[lo : hi + 1] * ((s - i) / s)
        now[lo == 0 :] += out[max(lo, 1) - 1 : hi] * (i[lo == 0 :] / s)
        out[lo : hi + 1] = np.where(np.abs(i * (m // g) - (s - i) * (n // g)) >= limit, 1.0, now)
    return float(out[n])


def one_sided(n: int, x: float) -> float:
    """The probability that the empirical distribution of n values exceeds the true one by x somewhere."""
    if n > SUMMED:
        return math.exp(-((6.0 * n * x + 1) ** 2) / (18.0 * n))
    log_fact = np.concatenate([[0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.longdouble)))])
    j = np.arange(int(math.floor(n * (1 - x))) + 1)
    a, b = x + j / np.longdouble(n), 1 - x - j / np.longdouble(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        last = np.where(n - j > 0, (n - j) * np.log(np.maximum(b, 0)), 0)
        terms = np.exp(log_fact[n] - log_fact[j] - log_fact[n - j] + (j - 1) * np.log(a) + last)
    return float(min(1.0, x * terms.sum()))


def _by_matrix(n: int, x: float) -> float:
    """The exact distribution function, as n! / n^n times an entry of the n-th power of a matrix of size 2 ceil(nx) - 1."""
    k = math.ceil(n * x)
    h, size = k - n * x, 2 * k - 1
    at = np.arange(size)
    fall = at[:, None] - at[None, :] + 1
    mat = (fall >= 0).astype(float)
    for i in range(size):
        mat[i, 0] -= h ** (i + 1)
        mat[size - 1, i] -= h ** (size - i)
    if 2 * h > 1:
        mat[size - 1, 0] += (2 * h - 1) ** size
    mat /= np.array([[math.factorial(f) if f > 0 else 1 for f in row] for row in fall.tolist()], float)
    power, scale, base, base_scale, left = np.eye(size), 0, mat, 0, n
    while left:
        if left & 1:
            power, scale = power @ base, scale + base_scale
        base, base_scale, left = base @ base, 2 * base_scale, left >> 1
        for which in (0, 1):  # keep entries near 1
            big = math.frexp((power if which == 0 else base).max())[1]
            if which == 0:
                power, scale = power / 2.0**big, scale + big
            else:
                base, base_scale = base / 2.0**big, base_scale + big
    value = power[k - 1, k - 1]
    log = math.log(value) + scale * math.log(2) + math.lgamma(n + 1) - n * math.log(n) if value > 0 else -math.inf
    return min(1.0, math.exp(log))


def _expansion(n: int, x: float) -> float:
    """The distribution function by its limit and three terms in powers of the root of n."""
    z = math.sqrt(n) * x
    pi2, z2 = math.pi**2, z * z
    half = (np.arange(-20, 20) + 0.5) ** 2 * pi2
    whole = np.arange(-20, 21) ** 2 * pi2
    near, far = np.exp(-half / (2 * z2)), np.exp(-whole / (2 * z2))
    c = math.sqrt(math.pi / 2)
    k0 = c / z * near.sum()
    k1 = c / (6 * z**4) * ((half - z2) * near).sum()
    k2 = c / (72 * z**7) * ((6 * z**6 + 2 * z**4 + half * (2 * z**4 - 5 * z2) + half**2 * (1 - 2 * z2)) * near).sum() - c / (36 * z**3) * (whole * far).sum()
    k3 = c / (6480 * z**10) * ((half**3 * (5 - 30 * z2) + half**2 * (-60 * z2 + 212 * z**4) + half * (135 * z**4 - 96 * z**6) - 30 * z**6 - 90 * z**8) * near).sum() + c / (108 * z**6) * ((-(whole**2) + 3 * whole * z2) * far).sum()
    return float(min(1.0, max(0.0, k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)))


def one_sample(n: int, x: float) -> float:
    """The probability that n values differ from their distribution by x or more somewhere, on either side."""
    t = n * x
    if x >= 1 or n < 1:
        return 0.0 if x >= 1 else 1.0
    if t <= 0.5:
        return 1.0
    if t <= 1:
        return 1 - math.exp(math.lgamma(n + 1) - n * math.log(n) + n * math.log(2 * t - 1)) if t > 0.5 else 1.0
    if t >= n - 1:
        return 2 * (1 - x) ** n
    square = t * x
    if x >= 0.5 or square >= (4 if n <= 140 else 2.2):
        return 0.0 if square >= 370 else min(1.0, 2 * one_sided(n, x))
    if n <= 140 or (n <= 100_000 and n * x**1.5 <= 1.4):
        return 1 - _by_matrix(n, x)
    return 1 - _expansion(n, x)


def p_value(n: int, m: int, statistic: float) -> float:
    """Of the two-sample statistic of n and m values, two-sided."""
    if max(n, m) <= EXACT_VALUES:
        return exact_two_sample(n, m, statistic)
    return one_sample(round(n * m / (n + m)), statistic)
