"""Exact random draws of how many of each kind fall into which share."""

from __future__ import annotations

import math

import numpy as np


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` out of ``good + bad``, for numbers of any size.

    The probabilities around the mean follow from the ratio of neighbours; what lies more than
    twelve standard deviations away weighs under 1e-30.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(mean * (bad / total) * (total - draws) / max(total - 1, 1))
    first = max(low, math.floor(mean - 12 * sd - 12))
    last = min(high, math.ceil(mean + 12 * sd + 12))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right").clip(0, len(upto) - 1))


def multivariate(rng: np.random.Generator, counts: list[int], draws: int) -> list[int]:
    """How many of each kind are among ``draws`` out of all."""
    rest, out = sum(counts), []
    for n in counts:
        rest -= n
        got = hypergeometric(rng, n, rest, draws)
        out.append(got)
        draws -= got
    return out


def splitting_tree(rng: np.random.Generator, counts: list[int], quotas: list[int]) -> list[list[int]]:
    """For each share its number of each kind: row and column sums are exact.

    The shares are halved again and again; each node of the tree draws what goes left.
    ``quotas`` and ``counts`` have the same sum.
    """
    if len(quotas) == 1:
        return [list(counts)]
    half = len(quotas) // 2
    left = multivariate(rng, counts, sum(quotas[:half]))
    right = [n - x for n, x in zip(counts, left, strict=True)]
    return splitting_tree(rng, left, quotas[:half]) + splitting_tree(rng, right, quotas[half:])


def even(total: int, shares: int) -> list[int]:
    """Shares at most one apart."""
    return [total // shares + (i < total % shares) for i in range(shares)]
