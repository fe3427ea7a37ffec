"""Hard negatives against brute force in whole numbers, and the bounds they are filtered by."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metrospect.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v string, anchor_id long"


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], label, "a", "b", 7) for i, v, label in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """All answers, by Python's integers."""
    used = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = [math.floor(scale * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label
        used[i] = min(used.get(i, row), row)
    out = set()
    for a, (av, al) in used.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, (v, label) in used.items() if i != a and len(v) == len(av))
        for ps, p, _ in [s for s in scored if s[2] == al][:positives]:
            inside = [(n, -ns) for ns, n, label in scored if label != al and low * -ps <= 100 * -ns <= high * -ps]
            out |= {(a, p, rank + 1, n, -ps, ns) for rank, (n, ns) in enumerate(inside[:negatives])}
    return out


def got(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = x[:6][rng.integers(0, 6, n - n // 2)] + rng.normal(size=(n - n // 2, dim)) * spread
    x[-n // 8:] = x[2]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block_bytes", [8 << 20, 4_000])
def test_exact(spark, block_bytes):
    x = clustered(700, 10, 3)
    rng = random.Random(1)
    rows = [(i, v, rng.choice([0, 0, 0, 1, 2, 3, 9])) for i, v in enumerate(x.tolist())]
    odd = [
        (None, x[0].tolist(), 1), (10_000, None, 1), (10_100, [], 1), (10_200, [1.0, None], 1), (10_300, [math.nan] * 10, 1),
        (10_400, [math.inf] * 10, 1), (10_500, x[1].tolist(), None), (10_600, [0.0] * 10, 0), (5, x[6].tolist(), 2), (5, x[5].tolist(), 0),
        (20_000, [1.0, 2.0], 1), (20_001, [2.0, 2.0], 1), (20_002, [1.0, 0.5], 2), (-700, x[9].tolist(), 3), (30_000, [0.5], 4)]
    want = brute(rows + odd)
    assert got(hn.mine(table(spark, rows + odd), block_bytes=block_bytes)) == want
    assert {r[0] for r in want} >= {0, 100, 600, -700, 20_000}


def test_other_numbers_and_unequal_norms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) * np.exp(rng.normal(size=(400, 1)) * 2)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x.tolist())]
    found = hn.mine(table(spark, rows), every=20, positives=3, negatives=4, low_percent=-50, high_percent=100, scale=9, block_bytes=6_000)
    assert got(found) == brute(rows, 20, 3, 4, -50, 100, 9)


def test_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(2**27, 2**28)) for _ in range(4)], i % 3) for i in range(0, 300)]
    want = brute(rows, every=50, scale=4, low=99, high=101)
    assert any(r[4] > 2**53 for r in want) and len(want) > 100
    assert got(hn.mine(table(spark, rows), every=50, scale=4, low_percent=99, high_percent=101)) == want


def test_nothing_to_find(spark):
    assert hn.mine(table(spark, [])).count() == 0
    assert hn.mine(table(spark, [(0, [1.0], 1), (100, [1.0], 2)])).count() == 0
    assert hn.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 1)])).count() == 0


def block_of(x, labels=None):
    v = np.floor(x * 256).astype(np.int64)
    part = pd.DataFrame({"vec_id": np.arange(len(v)), "label": np.zeros(len(v), int) if labels is None else labels, "v": list(v), "block": 0})
    return hn.opened(hn.built(part).iloc[0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([1e-3, 1.0, 1e6]))
def test_bounds_hold(n, dim, seed, size):
    block = block_of(clustered(n + 8, dim, seed, 1e-7) * size)
    v = block.v[::3]
    norms, angles = hn.lengths(v), hn.angles_to(v, hn.lengths(v), block.references)
    scores = hn.products(v, block.v, hn.fits_doubles(v, block.v)).astype(np.float64)
    for lower, upper in (block.row_bounds(norms, angles, np.arange(len(block.ids))), [b[:, block.group] for b in block.group_bounds(norms, angles)]):
        assert (lower <= scores).all() and (scores <= upper).all()


def test_few_pairs_are_scored(monkeypatch):
    """Of clustered rows, most are ruled out by their bounds alone."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    x = centres[rng.integers(0, 10, 4_000)] + rng.normal(size=(4_000, 32)) * 0.02
    block = block_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    scored = []
    real = hn.Block.scores
    monkeypatch.setattr(hn.Block, "scores", lambda self, asked, rows, wanted, fits: (scored.append(int(wanted.sum())), real(self, asked, rows, wanted, fits))[1])
    hn.nearest_alike(block, block.ids[:64], block.labels[:64], block.v[:64], 5)
    assert sum(scored) < 0.2 * 64 * 4_000
