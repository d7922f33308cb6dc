"""Recommendation by factors against scoring every article."""

import numpy as np
import pytest

from pressroom.operators.factors import als_recommend, best_by_factors, factors
from pressroom.operators.reading import read_log
from pressroom.sources.tables import events

SF = "/root/testdata/sf0.01"


def by_hand(users, articles, read, n):
    out = []
    for u, x in users:
        scored = sorted((-int(np.dot(np.array(x, object), np.array(y, object))), d) for d, y in articles if (u, d) not in read)
        out += [(u, d, -s, rk) for rk, (s, d) in enumerate(scored[:n], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("user_id", "doc_id", "score", "rk").collect())


def tables(spark, users, articles, read):
    return (
        spark.createDataFrame(users, "user_id bigint, x array<bigint>"),
        spark.createDataFrame(articles, "doc_id bigint, y array<bigint>"),
        spark.createDataFrame(sorted(read), "user_id bigint, doc_id bigint"),
    )


@pytest.mark.parametrize("spread", [0.0, 2.0])
@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "users_at_once": 7}])
def test_search_equals_scoring_everything(spark, spread, sizes):
    draw = np.random.default_rng(4)
    users = [(int(u), draw.integers(-50, 50, 4).tolist()) for u in range(40)] + [(900, [0, 0, 0, 0])]
    lengths = np.exp(spread * draw.normal(size=300))
    articles = [(int(3 * d), np.round(20 * lengths[d] * draw.normal(size=4)).astype(int).tolist()) for d in range(300)]
    read = {(u, d) for u, _ in users for d, _ in articles if (u * 7 + d) % 11 == 0} | {(0, d) for d, _ in articles[:290]}
    assert got(best_by_factors(*tables(spark, users, articles, read), n=6, **sizes)) == by_hand(users, articles, read, 6)


def test_ties_large_numbers_and_a_user_who_read_everything(spark):
    users = [(1, [1 << 29, 3]), (2, [1, 1]), (3, [-1, -1])]
    articles = [(d, [1 << 29, d % 2]) for d in range(8)] + [(100 + d, [5, 5]) for d in range(8)] + [(200, [0, 0])]
    read = {(2, d) for d, _ in articles}
    assert got(best_by_factors(*tables(spark, users, articles, read), n=5, shard=3)) == by_hand(users, articles, read, 5)


def test_few_shards_are_visited_where_norms_differ(spark):
    """Long articles are found first, so the short ones are not looked at."""
    articles = [(d, [1000, d]) for d in range(50)] + [(1000 + d, [1, d % 2]) for d in range(5_000)]
    found = best_by_factors(*tables(spark, [(1, [9, 0])], articles, {(1, 0)}), n=3, shard=100)
    assert [r[1] for r in got(found)] == [1, 2, 3]


def test_model_of_the_given_log_equals_scoring_everything(spark):
    reads = read_log(events(spark, SF))
    users, articles = factors(reads)
    read = {(r.user_id, r.doc_id) for r in reads.select("user_id", "doc_id").collect()}
    rows = [tuple(r) for r in users.collect()], [tuple(r) for r in articles.collect()]
    assert len(rows[0]) == 150 and all(len(x) == 8 for _, x in rows[0])
    assert got(best_by_factors(users, articles, reads)) == by_hand(*rows, read, 10)


def test_ids_beyond_32_bits_nulls_and_groups_of_readers(spark):
    far = 1 << 40
    rows = [(far + u, -far + d) for u in range(12) for d in range(12) if (u + d) % 2 == 0 and (u, d) != (0, 0)]
    reads = spark.createDataFrame([*rows, (None, 1), (1, None)], "user_id bigint, doc_id bigint")
    found = got(als_recommend(reads, n=1, rank=2))
    assert {r[0] for r in found} == {far + u for u in range(12)}
    # even users read even articles: what user 0 missed of these comes first
    assert (far, -far) in {(u, d) for u, d, _, _ in found}


def test_no_reads(spark):
    assert got(als_recommend(spark.createDataFrame([], "user_id bigint, doc_id bigint"))) == []
