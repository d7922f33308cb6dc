"""Operator 13 against brute force; the given tables are compared with SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm.negatives import (
    Search, angles_to, best_in_windows, hard_negatives, integer_vectors, reference_directions, score_bounds, scores,
)

KINDS = "vec_id bigint, label bigint, v array<bigint>, anchor boolean, shard int, cell string"


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "c") for r in rows], KINDS)


def by_hand(rows, positives=5, negatives=3):
    best = {}
    for i, label, v, anchor in rows:
        if None in (i, label, v) or None in v or sum(float(x) * x for x in v) > 9e16:
            continue
        if i not in best or (label, v) < best[i][1:3]:
            best[i] = (i, label, v, anchor)
    rows, out = sorted(best.values()), []

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2], strict=False))

    for a in (r for r in rows if r[3]):
        scored = sorted((-score(a, r), r[0], r[1]) for r in rows if r[0] != a[0])
        for s, i, _ in [x for x in scored if x[2] == a[1]][:positives]:
            inside = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a[0], i, n, x[1], -s, -x[0]) for n, x in enumerate(inside[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n, dims, spread, labels=4, scale=100):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    x = centres[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, dims))
    return [(i, int(draw.integers(0, labels)), np.floor(scale * v).astype(int).tolist(), i % 10 == 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 16, "anchors": 7, "references": 5}])
def test_equals_brute_force(vectors, spread, sizes):
    rows = made(3, 300, 8, spread)
    wanted = by_hand(rows)
    assert wanted
    assert got(hard_negatives(vectors(rows), **sizes)) == wanted


def test_ties_equal_vectors_and_zero_vectors(vectors):
    rows = [(i, i % 2, [3, 4], i % 5 == 0) for i in range(40)] + [(100 + i, i % 2, [0, 0], i == 0) for i in range(8)]
    rows += [(200 + i, 1, [4, 2], False) for i in range(6)] + [(300, 0, [-3, -4], True), (301, 0, [-1, -1], False)]
    assert got(hard_negatives(vectors(rows), shard_rows=8)) == by_hand(rows)


def test_nulls_repeated_ids_lengths_and_large_numbers(vectors):
    rows = [
        (0, 1, [5, 1], True), (0, 1, [5, 1], True), (0, 2, [9, 9], True), (None, 1, [5, 1], True), (1, None, [5, 1], False), (2, 1, None, False),
        (3, 1, [5, None], False), (4, 1, [5, 1, 7], False), (5, 1, [4], False), (6, 2, [3], False), (7, 2, [4, 0, 100], False), (8, 2, [], False),
        (9, 1, [10**6, 1], False), (10, 2, [7 * 10**5, 3], False), (11, 2, [10**9, 1], False), (12, 1, [2 * 10**8, 1], True), (13, 1, [10**8, 3], False),
        (14, 2, [9 * 10**7, 1], False),
    ]
    assert got(hard_negatives(vectors(rows))) == by_hand(rows)


def test_empty_table_and_an_anchor_alone(vectors):
    assert hard_negatives(vectors([(1, 1, [1], True)]).limit(0)).count() == 0
    assert hard_negatives(vectors([(1, 1, [1], True)])).count() == 0


def test_integer_vectors(spark):
    rows = [([0.5, -0.001],), ([None, 1.0],), ([math.nan],), ([math.inf],), (None,), ([],), ([3e38],)]
    df = spark.createDataFrame(rows, "x array<float>").select(integer_vectors(F.col("x")).alias("v"))
    assert [r.v for r in df.collect()] == [[128, -1], None, None, None, None, [], None]


def test_bounds_hold_and_filter():
    draw = random.Random(9)
    for dims in (1, 2, 3, 16):
        x = np.array([[draw.randint(-300, 300) for _ in range(dims)] for _ in range(200)])
        x[:20] = x[20:40] * 2
        x[40:50] = -x[20:30]
        x[50] = 0
        norms = np.sqrt((x * x).sum(1).astype(float))
        directions = x[:16] / np.maximum(norms[:16, None], 1)
        angles = angles_to(x, norms, directions).astype(np.float32).astype(np.float64)
        tight = 0
        for k in range(0, 200, 7):
            low, high = score_bounds(angles[k], norms[k], angles, norms)
            real = x @ x[k]
            assert (low <= real).all() and (real <= high).all()
            tight += int((high < real.max()).sum())
        assert tight


def test_few_rows_are_scored_where_directions_are_near():
    rows = made(1, 4_000, 16, 0.02)
    x = np.array([r[2] for r in rows])
    norms = np.sqrt((x * x).sum(1).astype(float))
    angles = angles_to(x, norms, x[:16] / norms[:16, None])
    real = x @ x[0]
    low, high = score_bounds(angles[0], norms[0], angles, norms)
    best, scored = best_in_windows(low, high, np.arange(len(x)), [(int(real.max() * 0.5), int(real.max() * 0.95))], 3, lambda at: real[at])
    inside = [i for i in np.lexsort((np.arange(len(x)), -real)) if real.max() * 0.5 <= real[i] <= int(real.max() * 0.95)][:3]
    assert [i for i, _ in best[0]] == inside
    assert scored < len(x) / 2


@pytest.mark.parametrize("top", [100, 10**6, 10**8])
def test_scores_are_exact_in_every_type(top):
    draw = random.Random(2)
    x = np.array([[draw.randint(-top, top) for _ in range(8)] for _ in range(50)], np.int64)
    norms = [math.sqrt(sum(float(c) * float(c) for c in row)) for row in x.tolist()]
    exact = [sum(a * b for a, b in zip(row, x[0].tolist(), strict=True)) for row in x.tolist()]
    assert scores(x, x[0], max(norms) * norms[0]).tolist() == exact


def test_shards_are_bounded_for_equal_vectors(vectors):
    search = Search(vectors([(i, 0, [1, 2], i == 0) for i in range(2_000)]), shard_rows=100)
    sizes = [r["count"] for r in search.rows.groupBy("shard").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 160


def test_directions_are_distinct(vectors):
    rows = vectors([(i, 0, [1, i % 3], False) for i in range(30)])
    assert reference_directions(rows).shape == (3, 2)
