import math

import numpy as np
import pytest

from switchback.llm.topk import _Segments, top_k


def brute(rows, k=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), math.inf if j is None else j) for b, (j, v) in enumerate(kept) if b != a)[:k]
            out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    return sorted((tuple(r) for r in top_k(df, **more).collect()), key=str)


def test_possible_members_hold_the_best():
    rng = np.random.default_rng(1)
    for n, dims, top in ((300, 8, 40), (1000, 64, 300), (50, 3, 2), (200, 4, 1 << 24)):
        x = rng.integers(-top, top, (n, dims))
        s = _Segments(x, np.argsort(x.T, axis=1, kind="stable").astype(np.uint16))
        for own in (-1, 3):
            for q in rng.integers(-top, top, (20, dims)):
                at, scores = s.top(q, 10, own), x @ q
                rest = np.setdiff1d(np.arange(n), [own])
                least = np.sort(scores[rest])[-10]
                assert own not in at and set(rest[scores[rest] >= least]) <= set(at)


def test_reading_ends_before_all_is_read_where_few_can_win():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (2000, 16))
    x[:12] += 900
    s = _Segments(x, np.argsort(x.T, axis=1, kind="stable").astype(np.uint16))
    assert len(s.top(np.full(16, 5), 10, -1)) < 100


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(310)]
    rows += [(i, rows[5][1]) for i in (400, 401, 402, 403, 500, 500)]
    assert run(spark, rows, block=block) == brute(rows)


def test_edge_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (7, [-1.0, 0.5]), (8, [3e4, 1.0])
    ]
    assert run(spark, rows) == brute(rows)
    top = 2**63 - 1
    rows += [(top, [1.0, 1.0]), (top, [1.0, 1.0]), (None, [1.0, 1.0]), (-top - 1, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []
