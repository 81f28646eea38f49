"""Centroid clustering against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tessella.llm import clusters


def loops(rows, k, rounds, dims, scale=64.0):
    ok = [(i, tuple(math.floor(scale * x) if math.isfinite(scale * x) else int(scale) * int(x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    if not (z := [v for _, v in first]):
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(z))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in ok]
        z = [[sum(v[d] for v in own) // len(own) for d in range(dims)] if (own := [v for (_, v), c in zip(ok, of, strict=True) if c == n]) else old for n, old in enumerate(z)]
    last = [(i, *near(v)) for i, v in ok] if z else []
    total, most = sum(d for _, d, _ in last), 2**63 - 1
    return sorted((str(i), c, min(d, most), min(most, sum(min(x, most) for _, x, y in last if y == c)), min(total, most), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for i, d, c in last)


def check(spark, rows, k=4, rounds=3, dims=3, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, distance string")
    got = clusters.clustered(df, k=k, rounds=rounds, dims=dims, **how)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == loops([r[:2] for r in rows], k, rounds, dims)


@pytest.mark.parametrize("seed", range(3))
def test_against_loops(spark, seed):
    rng = random.Random(seed)
    centre = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centre)], 7, "x") for i in range(400)]
    check(spark, rows, k=5, block=64)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i % 40, [float(rng.randrange(3)) for _ in range(3)], 0, "") for i in range(120)]  # ties, repeated ids and rows
    rows += [(None, [0.0, 1.0, 2.0], 0, ""), (500, None, 0, ""), (501, [1.0], 0, ""), (502, [1.0, None, 2.0], 0, ""), (503, [1.0, float("nan"), 2.0], 0, ""), (504, [float("inf"), 0.0, 0.0], 0, ""), (-7, [-0.001, 0.0, -5.5], 0, "")]
    check(spark, rows, block=16)
    check(spark, rows, k=200)
    check(spark, rows[:2], k=4)
    check(spark, [], k=4)
    check(spark, [(500, None, 0, ""), (None, [1.0, 2.0, 3.0], 0, "")], k=4)


def test_numbers_beyond_doubles_and_longs(spark):
    rows = [(i, [x * 1e20, x, -x * 3e9], 0, "") for i, x in enumerate([1.5, -2.25, 3.0, 1e-9, 7.0, -7.5])]
    check(spark, rows, k=2)
    check(spark, [(1, [1e308, 0.0, 0.0], 0, ""), (2, [-1e308, 1.0, 0.0], 0, ""), (3, [5.0, 1.0, 0.0], 0, "")], k=2)
    check(spark, [(i, [float(2**25 + i), 1.0, 0.0], 0, "") for i in range(9)], k=3)


def test_tree_holds_counts_sums_and_boxes_and_prunes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 3, (512, 4)) for c in (-900, 0, 900, 1800)]).astype(np.int64)
    t = clusters.Tree(x)
    for node in range(len(t.start)):
        own = x[t.rows(node)]
        if len(own):
            assert (own.min(0) == t.low[node]).all() and (own.max(0) == t.high[node]).all() and (own.sum(0) == t.sum[node]).all()
    done, left = t.filtered(np.array([[-900] * 4, [0] * 4, [900] * 4, [1800] * 4]))
    assert sum(t.end[i] - t.start[i] for i, _ in done) == 2048 and not left and len(done) < 10  # whole nodes, no point looked at


def test_strictly_dominated_centroids_only():
    x = np.array([[0, 0], [2, 0]])
    done, left = clusters.Tree(x).filtered(np.array([[-1, 0], [1, 0], [3, 0]]))  # every point ties
    assert not done and left[0][1].tolist() == [0, 1, 2]
