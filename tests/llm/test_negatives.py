from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pickline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score string, cell int, at long"


def brute(rows, every=100, scale=256, k=5, n=10, low=30, high=90):
    """The contract by plain loops over all pairs."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * x))) for x in v]
        known[i] = min(known.get(i, (label, whole)), (label, whole))
    most = (1 << 63) - 1
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        score = {b: max(-most, min(most, sum(x * y for x, y in zip(v, w)))) for b, (_, w) in known.items()}
        order = sorted((b for b in known if b != a), key=lambda b: (-score[b], b))
        for p in [b for b in order if known[b][0] == label][:k]:
            fits = [b for b in order if known[b][0] != label and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fits[:n])]
    return sorted(out)


def found(spark, rows, **settings):
    table = spark.createDataFrame(
        [(i, v if v is None else [x if x is None else float(x) for x in v], label, "x", "y", 1, 2)
         for i, v, label in rows], SCHEMA)
    got = negatives.hard_negatives(table.repartition(3), **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(rng, n, labels, dims=6):
    return [(i, [rng.gauss(0, 1) for _ in range(dims)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("cell", [40, 65_536])
def test_as_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell)
    rng = random.Random(cell)
    rows = vectors(rng, 300, [1] * 6 + [2, 3, 4, 5])  # one label holds most rows and many cells
    rows += [(300 + i, [1.0, 0, 0, 0, 0, 0], 7 + i % 2) for i in range(60)]  # ties
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0] * 6, None), (1002, [1.0, None], 1),
             (1003, [math.nan] * 6, 1), (1004, [math.inf] * 6, 2), (1100, [], 3), (1200, [0.5, 0.1], 4),
             (0, [0.0] * 9, 2), (0, [0.0] * 9, 2), (100, [5.0] * 8, 1), (-100, [0.3] * 6, 3), (1300, [0.0] * 6, 9)]
    want = brute(rows, every=20)
    assert found(spark, rows, every=20) == want and len(want) > 300


def test_numbers_beyond_doubles(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e6, -1e6, 3.7e7, 1e3]) + rng.random() for _ in range(4)], i % 3) for i in range(40)]
    rows += [(40, [1e300, -1e300, 1e18, 0.0], 1), (50, [1e300] * 4, 2)]
    assert found(spark, rows, every=10) == brute(rows, every=10)


def test_empty_and_without_partners(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_scan_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    n = 20_000
    rows = (rng.normal(size=(n, 8)) ** 3 * 40).astype(np.int64).astype(np.float64)
    lists = negatives.Lists(np.arange(n), rows, np.zeros(n, np.int64))
    for anchor in rows[:5]:
        window = negatives.Window(10)
        scored = negatives.scan(lists, anchor, [window])
        score = rows @ anchor
        best = np.lexsort((np.arange(n), -score))[:10]
        assert window.id.tolist() == best.tolist() and scored < n / 2
        low, high = int(score.max() * 0.3), int(score.max() * 0.9)
        window = negatives.Window(10, low, high)
        negatives.scan(lists, anchor, [window])
        inside = [i for i in np.lexsort((np.arange(n), -score)) if low <= score[i] <= high][:10]
        assert window.id.tolist() == inside


def test_an_equal_threshold_does_not_stop():
    # all score alike, so the least ids win wherever they lie in the lists
    rows = np.ones((500, 3))
    lists = negatives.Lists(np.arange(500)[::-1].copy(), rows, np.zeros(500, np.int64))
    window = negatives.Window(4)
    assert negatives.scan(lists, np.ones(3), [window]) == 500 and window.id.tolist() == [0, 1, 2, 3]
