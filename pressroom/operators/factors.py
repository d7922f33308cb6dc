"""Recommendation by factors: what users like, as short vectors learned from the read log.

1. *Model.* Users and articles get dense numbers, the places of their ids in order, so ids of any size fit what
   Spark's alternating least squares takes. It learns from how often a user read an article. Factors are
   rounded to multiples of ``1 / SCALE``, so that scores are integers and ties are real ones.
2. *Search.* The best ``n`` of all articles a user has not read, by inner product, without pairing all users
   with all articles. The product is at most that of the norms. Articles are put into classes by norm and these,
   longest first, into shards. Every user visits the first shard; the ``n``-th score found there is the floor,
   and of the other shards a user visits only those whose longest article can still reach it. The result is that of
   scoring every article.

A task scores at most ``USERS`` users with one shard of about ``SHARD`` articles; articles that a user read are
taken out there, so no larger pool is needed. Articles that nobody read have no factors and are not recommended.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.plans.ranks import numbered
from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import spread_join

SCALE = 1 << 20
# Classes of articles per doubling of the squared norm; there are no more than 63 times as many.
CLASSES = 4
SHARD = 4_096
USERS = 1 << 14
# Users that are scored at a time.
BLOCK = 256
MOST_NUMBERS = (1 << 31) - 1
NO_FLOOR = -(1 << 62)


def _numbered_ids(pairs: DataFrame, id_name: str) -> DataFrame:
    ids = numbered(pairs.select(id_name).distinct(), [id_name], name="number")
    ids = keep(ids)
    if stored_rows(ids) > MOST_NUMBERS:
        raise ValueError(f"{stored_rows(ids)} values of {id_name}: the model takes at most {MOST_NUMBERS}")
    return ids


def factors(reads: DataFrame, rank: int = 8, rounds: int = 10, seed: int = 7, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``user_id, x`` and ``doc_id, y``: the integer factors of users and articles, as stored tables."""
    pairs = keep(
        reads.filter("user_id is not null and doc_id is not null").groupBy("user_id", "doc_id").agg(F.count("*").alias("n"))
    )
    users, articles = _numbered_ids(pairs, "user_id"), _numbered_ids(pairs, "doc_id")

    def integers() -> Column:
        return F.transform("features", lambda f: F.round(f.cast("double") * SCALE).cast("bigint"))

    if not stored_rows(pairs):
        none = F.array().cast("array<bigint>")
        return keep(users.select("user_id", none.alias("x"))), keep(articles.select("doc_id", none.alias("y")))
    with_user = keep(spread_join(pairs, users.withColumnRenamed("number", "u"), ["user_id"], by="doc_id"))
    both = spread_join(with_user, articles.withColumnRenamed("number", "a"), ["doc_id"], by="user_id")
    ratings = keep(both.select(F.col("u").cast("int").alias("u"), F.col("a").cast("int").alias("a"), F.col("n").cast("float").alias("n")))
    als = ALS(rank=rank, maxIter=rounds, seed=seed, alpha=alpha, implicitPrefs=True, userCol="u", itemCol="a", ratingCol="n")
    model = als.fit(ratings)
    found = []
    for table, ids, id_name, name in ((model.userFactors, users, "user_id", "x"), (model.itemFactors, articles, "doc_id", "y")):
        named = table.select(F.col("id").cast("bigint").alias("number"), integers().alias(name))
        found.append(keep(ids.join(named, "number").select(id_name, name)))
    return found[0], found[1]


def _norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


def _products(x: np.ndarray, y: np.ndarray, longest: float) -> np.ndarray:
    """Exact products of all rows; no partial sum is above ``longest``, the product of the largest norms."""
    if longest < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


FOUND = "user_id bigint, doc_id bigint, score bigint"


def _best_of_shard(n: int) -> Callable:
    """The best ``n`` articles of a shard for each user who visits it."""

    def run(key: tuple, users: pa.Table, articles: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if users.num_rows and articles.num_rows:
            ids, y = articles.column("doc_id").to_numpy(), _rows(articles.column("y"))
            order = np.argsort(ids)
            ids, y = ids[order], y[order]
            long = articles.column("norm").to_numpy().max()
            for first in range(0, users.num_rows, BLOCK):
                some = users.slice(first, BLOCK)
                products = _products(_rows(some.column("x")), y, long * some.column("norm").to_numpy().max())
                floors = some.column("floor").to_pylist()
                read = some.column("read").to_pylist()
                for row, (user, scores) in enumerate(zip(some.column("user_id").to_pylist(), products, strict=True)):
                    open_to = scores >= floors[row]
                    if read[row]:
                        open_to &= ~np.isin(ids, read[row])
                    at = np.flatnonzero(open_to)
                    if len(at) > n:
                        own = scores[at]
                        at = at[own >= np.partition(own, len(own) - n)[len(own) - n]]
                    # ids are in order, so a stable sort puts the smaller one first
                    at = at[np.argsort(-scores[at], kind="stable")][:n]
                    out.append((np.full(len(at), user, np.int64), ids[at], scores[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(FOUND.split(", "), columns, strict=True)})

    return run


def best_by_factors(
    users: DataFrame, articles: DataFrame, reads: DataFrame, n: int = 10, shard: int = SHARD, users_at_once: int = USERS
) -> DataFrame:
    """``user_id, doc_id, score, rk``: of the articles a user has not read, the ``n`` of the largest products.

    ``users(user_id, x)`` and ``articles(doc_id, y)`` have integer vectors of one length. Ties go to the smaller id.
    """
    measured = keep(articles.select("doc_id", "y", _norm("y").alias("norm")).withColumn("cls", F.floor(2 * CLASSES * F.log2(F.col("norm") + 1))))
    classes = measured.groupBy("cls").agg(F.count("*").alias("rows"), F.max("norm").alias("longest")).orderBy(F.desc("cls")).collect()
    parts = [-(-c.rows // shard) for c in classes]
    begins = [sum(parts[:k]) for k in range(len(parts))]

    def of_class(values: list, kind: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for c, v in zip(classes, values, strict=True) for v in (c.cls, v)]), F.col("cls")).cast(kind)

    if not classes:
        return users.select("user_id", *[F.lit(0).cast("bigint").alias(c) for c in ("doc_id", "score", "rk")]).limit(0)
    place = of_class(begins, "bigint") + F.pmod(F.xxhash64("doc_id"), of_class(parts, "bigint"))
    placed = keep(measured.withColumn("shard", place))
    slices = max(1, -(-users.count() // users_at_once))
    dealt = placed.select("shard", "doc_id", "y", "norm", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    asking = keep(users.select("user_id", "x", _norm("x").alias("norm")))
    pairs = reads.select("user_id", "doc_id").filter("user_id is not null and doc_id is not null").distinct()
    known = keep(
        spread_join(keep(pairs), placed.select("doc_id", "shard"), ["doc_id"], by="user_id")
        .groupBy("user_id", "shard")
        .agg(F.collect_list("doc_id").alias("read"))
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "doc_id")

    def visit(visits: DataFrame) -> DataFrame:
        asked = visits.join(known, ["user_id", "shard"], "left").withColumn(
            "slice", F.pmod(F.xxhash64("user_id"), F.lit(slices)).cast("int")
        )
        return asked.groupBy("shard", "slice").cogroup(dealt.groupBy("shard", "slice")).applyInArrow(_best_of_shard(n), FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rk", F.row_number().over(order).cast("bigint")).filter(F.col("rk") <= n)

    no_floor = F.lit(NO_FLOOR).cast("bigint")
    first = keep(ranked(visit(asking.withColumns({"shard": F.lit(0).cast("bigint"), "floor": no_floor}))))
    floors = first.filter(F.col("rk") == n).select("user_id", F.col("score").alias("floor"))
    # Shards stand longest first: those that can reach the floor are the first ones.
    reach = F.array(*[F.struct(F.lit(c.longest).alias("longest"), F.lit(b + p - 1).cast("bigint").alias("last")) for c, b, p in zip(classes, begins, parts, strict=True)])
    able = F.filter(reach, lambda c: F.col("norm") * c["longest"] * (1 + 1e-9) + 1 >= F.col("floor"))
    last = F.coalesce(F.array_max(F.transform(able, lambda c: c["last"])), F.lit(0).cast("bigint"))
    rest = (
        asking.join(floors, "user_id", "left")
        .withColumn("floor", F.coalesce("floor", no_floor))
        .withColumn("last", last)
        .filter("last >= 1")
        .withColumn("shard", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"))))
        .drop("last")
    )
    return ranked(first.drop("rk").unionByName(visit(rest)))


def als_recommend(reads: DataFrame, n: int = 10, rank: int = 8) -> DataFrame:
    """``user_id, doc_id, score, rk``: the best ``n`` unread articles of each user by the factors of the read log."""
    users, articles = factors(reads, rank)
    return best_by_factors(users, articles, reads, n)
