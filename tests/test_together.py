"""Articles read by the same users, against brute force and in the shapes that would pair everything."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pressroom.operators.together import candidates, neighbour_offers, read_together
from pressroom.plans.ranks import numbered


@pytest.fixture(scope="module")
def log(spark):
    return lambda pairs: spark.createDataFrame([(u, d, "x", 1) for u, d in pairs], "user_id bigint, doc_id bigint, n string, block int")


def by_hand(pairs, k):
    readers = defaultdict(set)
    for u, d in pairs:
        if u is not None and d is not None:
            readers[d].add(u)
    out = []
    for i, a in readers.items():
        near = []
        for j, b in readers.items():
            if i != j and a & b:
                c = len(a & b)
                near.append((-(c * 1_000_000 // (len(a) + len(b) - c)), j, c))
        out += [(i, j, c, -jac, rk) for rk, (jac, j, c) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("i", "j", "c", "jac", "rk").collect())


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("shape", ["even", "skewed", "clusters"])
def test_equals_brute_force(log, k, shape):
    draw = random.Random(k)
    if shape == "even":
        pairs = [(draw.randint(0, 30), draw.randint(0, 40)) for _ in range(300)]
    elif shape == "skewed":
        pairs = [(int(30 * draw.random() ** 3), int(60 * draw.random() ** 3)) for _ in range(500)]
    else:
        pairs = [(10 * (d % 4) + draw.randint(0, 9), d) for d in range(50) for _ in range(draw.randint(1, 8))]
        pairs += [(99, d) for d in range(50)] + [(98, d) for d in range(0, 50, 2)]
    assert got(read_together(log(pairs), k)) == by_hand(pairs, k)


def test_nulls_repeated_reads_ties_and_no_rows(log):
    pairs = [(1, 5), (1, 5), (1, 6), (None, 5), (1, None), (2, 9), (3, 7), (3, -8), (4, 7), (4, -8), (1, 7)]
    assert got(read_together(log(pairs), 2)) == by_hand(pairs, 2)
    assert got(read_together(log(pairs).limit(0))) == []


@pytest.mark.parametrize("others", [0, 1, 2])
def test_one_user_who_read_everything_stays_linear(log, others):
    """Each article has 0, 1 or 2 readers of its own beside the one that all have."""
    n, k = 1_500, 5
    pairs = [(0, d) for d in range(n)] + [(1 + others * d + o, d) for d in range(n) for o in range(others)]
    met, _ = candidates(log(pairs), k)
    assert met.count() <= 4 * k * n
    assert got(read_together(log(pairs), k)) == by_hand(pairs, k)


def test_two_users_who_read_everything_stay_linear(log):
    n, k = 1_000, 4
    pairs = [(u, d) for d in range(n) for u in (0, 1, 10 + d)]
    met, _ = candidates(log(pairs), k)
    assert met.count() <= 4 * k * n


def test_places_of_rows(spark):
    rows = [(g, x) for g in range(3) for x in range(400 if g == 1 else 7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    assert numbered(df, ["x"], ["g"]).filter("place <> x + 1").count() == 0
    whole = numbered(df.filter("g = 1").withColumn("y", -F.col("x")), ["y"])
    assert whole.filter("place <> 400 - x").count() == 0
    assert numbered(df.limit(0), ["x"]).count() == 0


def test_offers_sum_up_the_neighbours_of_what_was_read(log):
    pairs = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3), (3, 2), (4, 9)]
    near = {(i, j): jac for i, j, _, jac, _ in by_hand(pairs, 2)}
    wanted = defaultdict(int)
    for u, i in pairs:
        for (a, j), jac in near.items():
            if a == i:
                wanted[u, j] += jac
    found = neighbour_offers(log(pairs), 2).select("user_id", "doc_id", "score").collect()
    assert sorted(tuple(r) for r in found) == sorted((u, j, s) for (u, j), s in wanted.items())
