"""Hard negatives against a plain search; the products against integers of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm.hard_negatives import PRIMES, _first, hard_negatives, primes_for, products, residues

SCHEMA = "ts bigint, features array<double>, regime bigint"


def plain(rows, step=5, n_positives=5, n_negatives=3):
    kept = []
    for ts, x, regime in rows:
        if regime is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((ts, [math.floor(256 * v) for v in x], regime))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (ts, x, regime) in enumerate(kept):
        if ts is None or ts % step:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), t, g) for b, (t, y, g) in enumerate(kept) if b != a]
        for s, t, _ in sorted((r for r in scored if r[2] == regime), key=order)[:n_positives]:
            inside = [r for r in scored if r[2] != regime and 50 * s <= 100 * r[0] <= 95 * s]
            for k, r in enumerate(sorted(inside, key=order)[:n_negatives]):
                out.append((ts, t, k + 1, r[1], s, r[0]))
    return sorted(out, key=repr)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in hard_negatives(df, F.col("ts") % 5 == 0, **how).collect()), key=repr)


@pytest.mark.parametrize("seed, width", [(1, 3), (2, 16), (3, 130)])
def test_random_snapshots(spark, seed, width):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(4, width)) + 1
    rows = [(int(k), (means[g] + 0.3 * rng.normal(size=width)).tolist(), int(g)) for k, g in enumerate(rng.integers(0, 4, 200))]
    got = mined(spark, rows, block_values=20 * width)
    assert got == plain(rows) and len(got) > 50


def test_ties_repeats_nulls_and_short_vectors(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), [float(rng.randint(0, 2)) for _ in range(rng.randint(0, 4))], rng.randrange(3)) for _ in range(150)]
    rows += [(None, [2.0, 2.0], 1), (None, [2.0, 2.0], 2), (5, None, 1), (10, [1.0, None], 1), (15, [float("nan")], 1), (20, [float("inf")], 0), (25, [1.0], None)]
    assert mined(spark, rows, block_values=60) == plain(rows)


def test_one_vector_for_most_rows(spark):
    rows = [(k, [1.0, 0.5], k % 2) for k in range(300)] + [(k, [0.9, 0.4], 7) for k in range(300, 330)]
    assert mined(spark, rows, block_values=100) == plain(rows)


def test_no_rows_no_anchors_and_other_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []
    df = spark.createDataFrame([(0, [1.0], "a", 1, 2), (1, [1.0], "a", 1, 2), (2, [0.75], "b", 1, 2)], "ts int, features array<float>, regime string, rank int, _row int")
    assert [tuple(r) for r in hard_negatives(df, F.col("ts") == 0).collect()] == [(0, 1, 1, 2, 65536, 49152)]


@pytest.mark.parametrize("size", [1, 300, 1 << 20, 1 << 25])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    x, y = rng.integers(-size, size, (20, 150)), rng.integers(-size, size, (30, 150))
    want = x.astype(object) @ y.T.astype(object)
    primes = primes_for(150 * size * size)
    assert (products(residues(x, primes), residues(y, primes), primes) == want).all()
    assert len(primes) == len(PRIMES) or 2 * 150 * size * size < math.prod(primes)


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        primes_for(1 << 60)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_first_takes_the_earliest_of_ties():
    score = np.array([[3, 5, 5, 5, 1], [0, 0, 0, 0, 0]])
    i, j = _first(score, np.array([[1, 1, 1, 1, 1], [0, 1, 0, 0, 0]], bool), 2)
    assert list(zip(i, j)) == [(0, 1), (0, 2), (1, 1)]
