"""Seeded hypergeometric draws for exact counts of any size (driver side, small tables)."""

from __future__ import annotations

import math

import numpy as np

_NUMPY_LIMIT = 10**9


def _log_pmf(k: int, good: int, bad: int, n: int) -> float:
    def choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    return choose(good, k) + choose(bad, n - k) - choose(good + bad, n)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among ``n`` drawn without replacement.

    numpy serves populations below its limit; larger ones are inverted outwards
    from the mode, which takes about one standard deviation of steps.
    """
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    u = rng.random()
    p_mode = math.exp(_log_pmf(mode, good, bad, n))
    u -= p_mode
    left = right = mode
    p_left = p_right = p_mode
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) / (right + 1) * (n - right) / (bad - n + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left / (good - left + 1) * (bad - n + left) / (n - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def multivariate(rng: np.random.Generator, colours: list[int], n: int) -> list[int]:
    """How many items of each colour are among ``n`` drawn without replacement."""
    out, rest = [], sum(colours)
    for c in colours:
        rest -= c
        k = hypergeometric(rng, c, rest, n)
        out.append(k)
        n -= k
    return out


def communication_matrix(rng: np.random.Generator, rows: list[int], cols: list[int]) -> list[list[int]]:
    """Random matrix with the given margins, as a uniform permutation would fill it.

    Halves the rows again and again, so a draw's population shrinks with the depth.
    """
    if len(rows) == 1:
        return [list(cols)]
    mid = len(rows) // 2
    first = multivariate(rng, cols, sum(rows[:mid]))
    second = [c - f for c, f in zip(cols, first, strict=True)]
    return communication_matrix(rng, rows[:mid], first) + communication_matrix(rng, rows[mid:], second)
