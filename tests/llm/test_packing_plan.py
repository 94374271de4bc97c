"""The packing plan on the driver: few rounds of pricing, and no sequence lost by that."""

from collections import Counter

import numpy as np

from stackroom.llm import packing


def test_few_rounds_of_pricing_reach_the_bound(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = sorted(rng.choice(np.arange(820, 4096), 96, replace=False).tolist(), reverse=True)
    demand = rng.integers(200, 900, 96).tolist()
    calls, real = [], packing._knapsack
    monkeypatch.setattr(packing, "_knapsack", lambda *a: calls.append(1) or real(*a))
    found = packing.configurations(sizes, demand, 4096)
    assert len(calls) <= 50  # one column a round took 110
    used = np.array([p for p, _ in found]).T @ np.array([n for _, n in found])
    assert all(sum(k * s for k, s in zip(p, sizes)) <= 4096 for p, _ in found) and (used <= demand).all()
    # What the rounding down leaves over is less than the patterns that it rounds.
    assert (np.array(demand) - used) @ sizes <= len(sizes) * 4096


def test_patterns_of_each_size_are_the_best_that_hold_it():
    sizes, values = np.array([50, 40, 31, 20]), np.array([0.6, 0.3, 0.31, 0.2])
    value, patterns = packing._knapsack(values, sizes, 100)
    assert abs(value - 1.2) < 1e-9 and (patterns @ sizes <= 100).all()
    assert np.allclose(patterns @ values, [1.2, 1.2, 0.3 + 0.6, 3 * 0.31, 0.6 + 2 * 0.2])
    assert all(patterns[k + 1][k] >= 1 for k in range(4))


def test_every_share_places_every_piece():
    rng = np.random.default_rng(6)
    counts = Counter(int(x) for x in rng.integers(1, 4097, 6000))
    volume = -(-sum(k * n for k, n in counts.items()) // 4096)
    for share in packing.LARGE:
        runs, bins = packing.grouped_plan(dict(counts), 4096, 64, share)
        at, placed = Counter(), Counter()
        for ln, lo, hi, first, per, offset in runs:
            placed[ln] += hi - lo
            for r in range(lo, hi):
                s, o = first + (r - lo) // per, offset + (r - lo) % per * ln
                assert o == at[s]
                at[s] += ln
        assert placed == counts and len(at) == bins and max(at.values()) <= 4096 and bins <= volume * 1.03
