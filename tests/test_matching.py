"""One-to-one matching of boundaries against all matchings of small lists."""

import random
from itertools import combinations

import pytest

from stridewell.operators.evaluation import matched_pairs, pair_up


def best(p, r, tolerance):
    """(pairs, least distance) by trying every choice."""
    for n in range(min(len(p), len(r)), 0, -1):
        costs = [
            sum(abs(a - b) for a, b in zip(x, y))
            for x in combinations(p, n)
            for y in combinations(r, n)
            if all(abs(a - b) <= tolerance for a, b in zip(x, y))
        ]
        if costs:
            return n, min(costs)
    return 0, 0


def test_known_cases():
    assert list(pair_up([10, 11], [11], 1)) == [(11, 11)]
    assert list(pair_up([7], [], 0)) == []
    assert list(pair_up([2, 4], [0, 3], 2)) == [(2, 0), (4, 3)]


def test_against_all_matchings(spark):
    rng = random.Random(2)
    sides = {0: [], 1: []}
    want = {}
    for source in range(40):
        lists = [sorted(rng.choices(range(14), k=rng.randrange(7))) for _ in range(2)]
        tolerance = 2
        pairs = list(pair_up(*lists, tolerance))
        assert (len(pairs), sum(abs(a - b) for a, b in pairs)) == best(*lists, tolerance)
        assert all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(pairs, pairs[1:]))
        want[source] = best(*lists, tolerance)
        for k in (0, 1):
            sides[k] += [(source, f) for f in lists[k]]
    frames = [spark.createDataFrame(sides[k], "source_id long, frame long") for k in (0, 1)]
    got = {}
    for r in matched_pairs(*frames, 2).collect():
        n, cost = got.get(r.source_id, (0, 0))
        got[r.source_id] = n + 1, cost + abs(r.offset)
    assert got == {s: w for s, w in want.items() if w[0]}
    with pytest.raises(ValueError):
        matched_pairs(*frames, -1)
