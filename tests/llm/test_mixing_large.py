"""Budgets over sources of a few documents that hold more words than one window."""

import random
from itertools import product

from lectio.llm.mixing import WINDOW, fit_budget


def off(sizes, take, budget):
    return abs(sum(s * t for s, t in zip(sizes, take)) - budget)


def test_greedy_pick_is_undone():
    sizes = [84_999, 85_001, 100_000]
    assert fit_budget(sizes, [1, 1, 1], 170_000) == [1, 1, 0]


def test_few_long_documents_against_brute_force():
    r = random.Random(9)
    for _ in range(150):
        sizes = r.sample(range(1_000, 2 * WINDOW), r.randint(2, 6))
        counts = [r.randint(1, 3) for _ in sizes]
        budget = r.uniform(0, sum(a * b for a, b in zip(sizes, counts)))
        best = min(off(sizes, t, budget) for t in product(*(range(c + 1) for c in counts)))
        got = fit_budget(sizes, counts, budget)
        assert all(0 <= x <= c for x, c in zip(got, counts))
        assert off(sizes, got, budget) <= max(0.5, best) + 1e-6


def test_distinct_lengths_are_taken_evenly():
    sizes = list(range(100, 4_100))
    budget = sum(sizes) / 2
    got = fit_budget(sizes, [1] * len(sizes), budget)
    assert off(sizes, got, budget) <= 0.5
    assert all(abs(sum(got[k : k + 1_000]) - 500) < 60 for k in range(0, 4_000, 1_000))
