"""What the fitted patterns do for packing, beside best fit alone."""

import random

import pytest

from plumbline.llm import packing


def best_fit(histogram, max_len):
    plan = packing.PackingPlan(max_len)
    for n in sorted(histogram, reverse=True):
        plan.best_fit(n, 0, histogram[n])
    return plan.bins


@pytest.mark.parametrize("scale", [1, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_most_sequences_come_from_patterns(seed, scale):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(10_000):
        n = min(4096, max(1, int(rng.lognormvariate(6.3, 1.1))))
        histogram[n] = histogram.get(n, 0) + scale
    plan = packing.make_plan(histogram, 4096)
    full = histogram.get(4096, 0)
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    print(seed, scale, plan.bins, least, best_fit(histogram, 4096), plan.fitted / (plan.bins - full))
    assert plan.bins <= max(best_fit(histogram, 4096), least * 1.0005 + 1)
    assert plan.fitted >= 0.7 * (plan.bins - full)
    # every rank of every length once, and no sequence beyond its length
    ranks, ends = {}, {}
    rows = sorted(plan.rows)
    for i, (n, rank, first, offset) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else histogram[n]
        assert rank == ranks.get(n, 0) and offset + n <= 4096
        ranks[n] = end
        if scale == 1:
            for s in range(first, first + end - rank):
                ends.setdefault(s, []).append((offset, n))
    assert ranks == histogram
    for places in ends.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n


def test_ranks_go_on_over_batches():
    import numpy as np

    ranks = packing.Ranks(9)
    got = [ranks.add(np.array(x, dtype=np.int64)).tolist() for x in ([3, 3, 9, 1], [], [9, 3, 3])]
    assert got == [[0, 1, 0, 0], [], [1, 2, 3]]
