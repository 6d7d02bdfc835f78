"""Hard negatives against plain loops over exact integers."""

import math

import pytest
from pyspark.sql import types as T

from gridhour.llm import hard_negatives as H

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def brute(rows):
    taken = []
    for i, x, label in dict.fromkeys((i, None if x is None else tuple(x), label) for i, x, label in rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        taken.append((i, label, tuple(math.floor(256 * v) if abs(v) < 1e13 else int(v) * 256 for v in x)))
    bound = lambda v: max(-H.LONG, min(H.LONG, v))
    out = []
    for k, (a, label, q) in enumerate(taken):
        if a is None or a % 100:
            continue
        scored = [(bound(sum(s * t for s, t in zip(q, r))), i is None, i, other) for j, (i, other, r) in enumerate(taken) if j != k]
        scored.sort(key=lambda s: (-s[0], s[1], s[2] or 0))
        for p in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(a, p[2], rank, s[2], p[0], s[0]) for rank, s in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


def check(spark, rows, **how):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows)
    return got


def made(rng, n, width=6, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.randrange(4)) for i in range(n)]


def test_many_blocks_ties_and_copies(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = made(rng, 900)
    rows += [(2000 + i, rows[5][1], i % 4) for i in range(300)]  # a third of all rows share one vector
    rows += [(5000 + i, [round(v) / 2 for v in rows[i][1]], rows[i][2]) for i in range(200)]  # many equal scores
    rows += rows[:50]
    monkeypatch.setattr(H, "SMALL_BLOCK", 64)
    assert check(spark, rows)
    assert check(spark, rows, block=16)


def test_edge_rows(spark):
    import random

    rng = random.Random(4)
    rows = made(rng, 40) + [
        (100, None, 1), (200, [1.0, None, 2.0], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1), (500, [1.0] * 6, None),
        (600, [], 1), (700, [0.0] * 6, 2), (800, [1.0, 2.0], 1), (900, [0.5] * 9, 1), (None, [0.9] * 6, 1), (None, [0.4] * 6, 2),
        (1000, [0.5] * 6, 3), (1000, [0.25] * 6, 3), (1000, [0.5] * 6, 2), (1100, [-1.0] * 6, -5), (-100, [0.7] * 6, 3),
    ]
    assert check(spark, rows)
    assert check(spark, []) == []


def test_large_numbers_are_exact(spark):
    import random

    rng = random.Random(5)
    assert check(spark, made(rng, 30, spread=3e5) + made(rng, 30, spread=1e-3))
    check(spark, [(100 * i, [rng.choice([1e17, -3e16, 5.0]) * rng.random() for _ in range(3)], i % 2) for i in range(20)])


def test_bounds_hold_the_exact_product():
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 50, 0) + 1e-3 * rng.normal(size=(50, 8)), np.zeros((1, 8))])
    q = H._integers(x)
    norm = H._norms(q)
    angles = H._angles(q, norm, q[:5] / norm[:5, None])
    side = {"norm": norm, "cos": np.cos(angles), "sin": np.sin(angles)}
    low, high = H._bounds(side, side)
    exact = H._products(q, q)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < exact.max()).mean() > 0.2


def test_columns_with_clashing_names(spark):
    import random

    rows = made(random.Random(7), 120)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "'a' AS key", "1 AS id", "2 AS x", "3 AS block", "4 AS rank", "5 AS score")
    assert sorted(map(tuple, H.hard_negatives(more).collect())) == sorted(map(tuple, H.hard_negatives(df).collect()))


@pytest.mark.parametrize("positive", [-7, 0, 1, 7, 10**18])
def test_window(positive):
    low, high = H.window(positive)
    for s in {low - 1, low, high, high + 1}:
        assert (low <= s <= high) == (30 * positive <= 100 * s <= 90 * positive)
