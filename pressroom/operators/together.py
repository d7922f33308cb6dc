"""Articles that the same users read: for each the ``k`` most similar ones, by the sets of their readers.

With ``c`` common readers of articles of ``n`` and ``m`` readers the similarity is ``c / (n + m - c)``, in millionths.
Users who read much would pair nearly all articles, so no pair is formed for a user but those that can
still be among the best ``k`` of an article (a set-similarity join with a floor for each article):

1. *Lists.* The articles of each user stand in a list, those of few readers first, as with one common reader
   these are the most similar. A list is cut into blocks of doubling length.
2. *Floors.* The first ``k + 1`` of every list meet the readers of that list. Counting how often two articles meet
   gives a lower bound of their similarity, and the ``k``-th best bound, with its article, is what the result
   of an article is sure to reach.
3. *Bounds.* Users are ordered by how many articles they read, in classes. If a user is the first common one of
   two articles, no more readers are common than the articles have in that class and later ones. A
   user whose bound is below the floor is no use to an article (the prefix filter). In the list of another one the
   bound falls with the number of readers, so an article needs only the first blocks of it: the more
   users a list has in common with nobody else, the fewer.
4. *Counts.* For the pairs left, the readers of the smaller set are looked up in the larger one.

The result is exact. Where floors are met by many articles alike, the smaller id counts, also in the bounds, so
articles that all share only one busy user meet ``k`` others each, not all.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.plans.ranks import numbered
from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import HOT_ROWS, spread_join

# Classes of users per doubling of what they read.
CLASSES = 8
MILLION = 1_000_000
MANY = (1 << 62) - 1


def _jac(c: str, n: str, m: str) -> Column:
    return F.expr(f"{c} * {MILLION} div ({n} + {m} - {c})")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs(i, j, jac, ..)`` with the rank ``rk``, the best ``k`` of each ``i``."""
    order = Window.partitionBy("i").orderBy(F.desc("jac"), "j")
    return pairs.withColumn("rk", F.row_number().over(order).cast("bigint")).filter(F.col("rk") <= k)


def _entries(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists as ``user_id, cls, doc_id, n, left, block`` and, as ``user_id, blocks``, where their blocks begin.

    ``n`` is the number of readers of the article, ``left`` how many of these are of class ``cls`` or later.
    """
    pairs = keep(reads.select("user_id", "doc_id").filter("user_id is not null and doc_id is not null").distinct())
    readers = keep(pairs.groupBy("doc_id").agg(F.count("*").alias("n")))
    users = keep(
        pairs.groupBy("user_id").agg(F.count("*").alias("many")).select("user_id", F.floor(F.log2("many") * CLASSES).alias("cls"), "many")
    )
    classed = keep(
        spread_join(
            pairs, users.select("user_id", "cls"), ["user_id"], by="doc_id", sizes=users.withColumnRenamed("many", "rows")
        )
    )
    later = Window.partitionBy("doc_id").orderBy(F.desc("cls"))
    lefts = keep(
        classed.groupBy("doc_id", "cls").agg(F.count("*").alias("c")).withColumn("left", F.sum("c").over(later)).drop("c")
        .join(readers, "doc_id")
    )
    full = spread_join(classed, lefts, ["doc_id", "cls"], by="user_id")
    placed = numbered(full, ["n", "doc_id"], ["user_id"])
    lists = keep(placed.withColumn("block", F.floor(F.log2("place")).cast("int")))
    blocks = lists.groupBy("user_id", "block").agg(
        F.min(F.struct("n", "doc_id")).alias("first"), F.max("n").alias("most")
    )
    begins = blocks.groupBy("user_id").agg(
        F.collect_list(F.struct("block", F.col("first.n").alias("n"), F.col("first.doc_id").alias("doc_id"), "most")).alias("blocks")
    )
    return lists, keep(begins)


def _floors(lists: DataFrame, k: int) -> DataFrame:
    """``doc_id, floor, last``: a similarity that the best ``k`` reach, and its article; none for articles with fewer partners."""
    shelf = lists.filter(F.col("place") <= k + 1).select("user_id", F.col("doc_id").alias("j"), F.col("n").alias("m"))
    met = spread_join(
        lists.select("user_id", F.col("doc_id").alias("i"), "n"),
        shelf,
        ["user_id"],
        by="i",
        on=F.col("i") != F.col("j"),
        at_most=stored_rows(lists),
    )
    sure = met.groupBy("i", "j", "n", "m").agg(F.count("*").alias("c")).withColumn("jac", _jac("c", "n", "m"))
    return keep(
        _best(sure.select("i", "j", "jac"), k)
        .filter(F.col("rk") == k)
        .select(F.col("i").alias("doc_id"), F.col("jac").alias("floor"), F.col("j").alias("last"))
    )


def _seeks(lists: DataFrame, begins: DataFrame, floors: DataFrame) -> DataFrame:
    """``user_id, block, i, n, left, floor, last``: the blocks that an article has to look through."""
    known = spread_join(
        lists.select("user_id", "doc_id", "n", "left"),
        floors,
        ["doc_id"],
        by="user_id",
        how="left",
        at_most=stored_rows(lists),
    ).select(
        "user_id", F.col("doc_id").alias("i"), "n", "left",
        F.coalesce("floor", F.lit(0)).alias("floor"), F.coalesce("last", F.lit(MANY)).alias("last"),
    )
    # Even a set of just the readers left would not reach the floor: that user is behind the prefix.
    useful = known.filter(F.expr(f"left * {MILLION} div n >= floor"))
    # The most readers a partner may have, and the fewest.
    bounded = keep(
        useful.withColumn("hi", F.expr(f"if(floor = 0, {MANY}, left * {MILLION} div greatest(floor, 1) - n + left)"))
        .withColumn("above", F.expr(f"left * {MILLION} div (floor + 1) - n + left"))
        .withColumn("lo", F.expr(f"(floor * n + {MILLION - 1}) div {MILLION}"))
    )
    with_blocks = spread_join(bounded, begins, ["user_id"], by="i")

    def wanted(b: Column) -> Column:
        # in a block of one size that only equals the floor, a smaller id is needed
        near = (b["n"] <= F.col("above")) | (b["most"] > b["n"]) | (b["doc_id"] <= F.col("last"))
        return (b["n"] <= F.col("hi")) & (b["most"] >= F.col("lo")) & near

    return with_blocks.select(
        "user_id", "i", "n", "left", "floor", "last", F.explode(F.transform(F.filter("blocks", wanted), lambda b: b["block"])).alias("block")
    )


def candidates(reads: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``s, l``: pairs of articles to be counted, the one of fewer readers first; and the lists."""
    lists, begins = _entries(reads)
    seeks = keep(_seeks(lists, begins, _floors(lists, k)))
    other = lists.select("user_id", "block", F.col("doc_id").alias("j"), F.col("n").alias("m"), F.col("left").alias("left_j"))
    most = _jac("least(left, left_j)", "n", "m")
    fits = (F.col("i") != F.col("j")) & ((most > F.col("floor")) | ((most == F.col("floor")) & (F.col("j") <= F.col("last"))))
    met = spread_join(seeks, other, ["user_id", "block"], by="i", on=fits)
    ordered = [F.struct(F.col(a).alias("n"), F.col(b).alias("id")) for a, b in (("n", "i"), ("m", "j"))]
    pairs = met.select(F.least(*ordered).alias("s"), F.greatest(*ordered).alias("l")).distinct()
    return keep(pairs.select(F.col("s.id").alias("s"), F.col("l.id").alias("l"), F.col("s.n").alias("n"), F.col("l.n").alias("m"))), lists


def read_together(reads: DataFrame, k: int = 10) -> DataFrame:
    """``i, j, c, jac, rk``: the ``k`` articles ``j`` with the most similar sets of readers, for each article.

    ``c`` is the number of common readers, at least one; ``jac`` their share, in millionths, of all readers of either.
    Ties go to the smaller ``j``. Reads without a user or article are left out.
    """
    pairs, lists = candidates(reads, k)
    reader = lists.select("user_id", "doc_id")
    # An article of many pairs and one of many readers are both dealt out.
    by_reader = "user_id" if stored_rows(lists) > HOT_ROWS else None
    asked = spread_join(pairs, reader.withColumnRenamed("doc_id", "s"), ["s"], by="l", other_by=by_reader)
    common = asked.join(reader.withColumnRenamed("doc_id", "l"), ["l", "user_id"], "left_semi")
    counted = common.groupBy("s", "l", "n", "m").agg(F.count("*").alias("c")).withColumn("jac", _jac("c", "n", "m"))
    sides = F.inline(F.array(F.struct(F.col("s").alias("i"), F.col("l").alias("j")), F.struct(F.col("l").alias("i"), F.col("s").alias("j"))))
    return _best(counted.select(sides, "c", "jac"), k)


def neighbour_offers(reads: DataFrame, k: int = 10) -> DataFrame:
    """``user_id, doc_id, score``: what is read together with the articles of a user, those read included.

    Every article offers its ``k`` neighbours, and the score of an offer is the sum of their similarities, so a user
    gets at most ``k`` offers for each article read.
    """
    neighbours = keep(read_together(reads, k)).select(F.col("i").alias("doc_id"), "j", "jac")
    pairs = keep(reads.select("user_id", "doc_id").filter("user_id is not null and doc_id is not null").distinct())
    offers = spread_join(pairs, neighbours, ["doc_id"], by="user_id")
    return offers.groupBy("user_id", F.col("j").alias("doc_id")).agg(F.sum("jac").alias("score"))
