"""Exact-count draws on the driver: small matrices of counts, never rows."""

from __future__ import annotations

import numpy as np


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` items drawn without replacement from ``good + bad`` are good.

    Inverts the distribution over twelve deviations around its mode, so totals are not
    limited as in numpy's sampler.
    """
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    spread = 12 * int(np.sqrt(take * (good / total) * (bad / total) * max(total - take, 1) / max(total - 1, 1)) + 2)
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(take - k[:-1]) - np.log(k[1:]) - np.log(bad - take + k[1:])
    weight = np.r_[0.0, np.cumsum(step)]
    law = np.cumsum(np.exp(weight - weight.max()))
    return int(k[int(np.searchsorted(law, rng.random() * law[-1], "right").clip(0, len(k) - 1))])


def multivariate(rng: np.random.Generator, counts: list[int], take: int) -> list[int]:
    """``take`` items drawn without replacement from classes of the given counts: how many of each class."""
    left, drawn = sum(counts), []
    for n in counts:
        left -= n
        k = hypergeometric(rng, n, left, take)
        drawn.append(k)
        take -= k
    return drawn


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> list[list[int]]:
    """Counts from each row to each column with exact margins, as a uniform random permutation would give."""
    free, matrix = list(columns), []
    for n in rows:
        drawn = multivariate(rng, free, n)
        free = [f - d for f, d in zip(free, drawn)]
        matrix.append(drawn)
    return matrix


def splitting_tree(rng: np.random.Generator, quotas: list[int], capacities: list[int]) -> list[list[int]]:
    """Counts of each quota for each leaf: the leaves are halved, and each half's share drawn, until one is left."""
    if len(capacities) == 1:
        return [list(quotas)]
    half = len(capacities) // 2
    left = multivariate(rng, quotas, sum(capacities[:half]))
    right = [q - k for q, k in zip(quotas, left)]
    return splitting_tree(rng, left, capacities[:half]) + splitting_tree(rng, right, capacities[half:])
