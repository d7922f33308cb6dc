"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole.

Texts are equal when they are the same after all white space (space, tab, line feed, vertical tab,
form feed, carriage return) is deleted; null counts as empty. Of equal texts the row with the most
code points in the original text stays, then the smallest ``doc_id``; a null ``doc_id`` loses ties.

Defined results: rows repeated with the same id and text count in ``group_size``, all have
``kept`` true if one has, and ``exact_dedup`` leaves one of them. A row with a null id has a null
``keep_id`` if it stays. Empty texts form one group. An empty table gives an empty result. Only
``doc_id`` and ``text`` are looked at; other columns pass through ``exact_dedup`` unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import bucket, in_buckets_of, row_key, unused, without
from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import spread_join

# The characters that do not count.
GAPS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for gap in GAPS:
        text = F.replace(text, F.lit(gap), F.lit(""))
    return text


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The buckets of key values that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").select(bucket(*keys).alias("bucket"))


def exact_groups(docs: DataFrame, prefix: int = 256, digest: bool = False) -> DataFrame:
    """``row, doc_id, keep_id, group_size, kept, full_hash`` for every row.

    Each step counts its key over all rows that the step before left, and sends on only rows whose
    key some other row has too. What is broadcast between steps is a set of at most ``BUCKETS``
    integers; a row that passes by chance costs one hash and ends alone. Only rows that passed are
    grouped by ``full_hash`` and shuffled; it is null for the others, unless ``digest`` asks for the
    hash of every row, which these then carry as a column and no more.
    """
    rows = docs.select(
        row_key().alias("row"),
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
        normalised(F.col("text")).alias("whole"),
    ).withColumn("n", F.length("whole"))
    lengths = keep(_shared(rows.select("n"), "n").distinct())
    second = in_buckets_of(rows, ["n"], lengths).select("n", F.xxhash64(F.left("whole", F.lit(prefix))).alias("p"))
    prefixes = keep(_shared(second, "n", "p").distinct())

    third = rows.withColumn("p", F.xxhash64(F.left("whole", F.lit(prefix)))).withColumn("_b", bucket("n", "p"))
    survivors = F.broadcast(prefixes.select(F.col("bucket").alias("_b"), F.lit(True).alias("hot")))
    wanted = F.lit(True) if digest else F.col("hot")
    stamped = keep(
        third.join(survivors, "_b", "left").select(
            "row", "doc_id", "points", F.coalesce("hot", F.lit(False)).alias("hot"),
            F.when(wanted, F.unhex(F.sha2("whole", 256))).alias("full_hash"),
        )
    )
    left = stamped.filter("hot")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id"))
    groups = left.groupBy("full_hash").agg(F.count("*").alias("group_size"), best.alias("best"))
    best_id, most = F.col("best.doc_id"), -F.col("best.p")
    met = spread_join(left, groups, ["full_hash"], by="row", at_most=stored_rows(stamped)).select(
        "row",
        "doc_id",
        best_id.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(best_id) & (F.col("points") == most)).alias("kept"),
        "full_hash",
    )
    alone = stamped.filter("not hot").select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "full_hash",
    )
    return met.unionByName(alone)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, all columns as they were."""
    groups = keep(exact_groups(docs))
    left = without(docs, row_key(), keep(groups.filter("not kept").select("row")))
    if not groups.filter("kept").groupBy("row").count().filter("count > 1").isEmpty():
        row = unused("_row", left)
        left = left.withColumn(row, row_key()).dropDuplicates([row]).drop(row)
    return left
