"""Joins for keys that may hold a large share of all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.plans.scratch import stored_rows

# A key with more than 1/HOT of all rows is hot, so there are fewer than HOT of them: that is
# the bound on what is broadcast. Keys of few rows are never worth splitting.
HOT = 1_000
HOT_ROWS = 1_000_000
# Rows that one task puts in order or joins, on average, where rows are dealt by number. It steers cost only.
DEALT_ROWS = 1 << 21
# How many values a sieve of keys broadcasts at most, whatever the number of keys.
SIEVE = 1 << 20


def dealt_parts(df: DataFrame, rows: int | None) -> int | None:
    """Into how many parts ``rows`` are to be dealt; None where Spark's own number of parts is enough, or ``rows`` is not known.

    Spark deals any number of rows into the same number of parts, so what a task holds grows with the table.
    """
    parts = -(-(rows or 0) // DEALT_ROWS)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df``, of ``rows`` at most, dealt by ``keys`` into parts that grow in number with the rows, not in size."""
    parts = dealt_parts(df, rows)
    return df.repartition(parts, *keys) if parts else df


def key_sizes(many: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows``: how many rows each key has."""
    return many.groupBy(*keys).agg(F.count("*").alias("rows"))


def hot_keys(sizes: DataFrame, keys: list[str], share: int, rows: int) -> DataFrame:
    """``keys, parts`` for the keys that need splitting, fewer than ``share`` rows."""
    limit = sizes.agg(F.greatest(F.sum("rows") / share, F.lit(float(rows)))).scalar()
    return (
        sizes.withColumn("limit", limit)
        .filter(F.col("rows") > F.col("limit"))
        .select(*keys, F.ceil(F.col("rows") / F.col("limit")).alias("parts"))
    )


def only_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted``: all that are, and some others.

    Keys are compared by a hash of ``SIEVE`` values, so no more than these are broadcast. It spares most
    rows a shuffle in the join that follows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(SIEVE)).cast("int").alias("_place")
    few = F.broadcast(wanted.select(place).distinct())
    return df.select("*", place).join(few, "_place", "left_semi").drop("_place")


def spread_join(
    many: DataFrame,
    other: DataFrame,
    keys: list[str],
    by: str,
    on: Column | None = None,
    how: str = "inner",
    sizes: DataFrame | None = None,
    at_most: int | None = None,
    share: int | None = None,
    rows: int | None = None,
    other_by: str | None = None,
) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``many`` are spread over several tasks.

    The rows of a hot key are dealt into parts by the hash of column ``by``; the matching rows of
    ``other`` are repeated once per part. Only the hot keys and their part counts are broadcast.
    ``many`` is read twice, so it should be a stored or cheap table; ``sizes`` saves one reading
    where the rows per key are known. Where ``many`` has ``at_most`` so few rows that no key can be
    hot, known for a stored table, it is a plain join.

    With ``other_by``, keys may be hot in ``other`` too, a stored table: its rows are dealt out by that
    column in the same way, and those of ``many`` repeated. Only for inner joins.
    """
    share, rows = share or HOT, rows or HOT_ROWS
    if at_most is None:
        at_most = stored_rows(many)
    at_most_other = stored_rows(other) if other_by else 0
    sides = []
    if at_most is None or at_most > rows:
        sides.append((sizes if sizes is not None else key_sizes(many, keys), "_part"))
    if at_most_other is None or at_most_other > rows:
        sides.append((key_sizes(other, keys), "_other_part"))
    for found, part in sides:
        hot = F.broadcast(hot_keys(found, keys, share, rows))
        parts = F.coalesce(F.col("parts"), F.lit(1).cast("bigint"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))

        def dealt(df: DataFrame, column: str) -> DataFrame:
            return df.join(hot, keys, "left").withColumn(part, F.pmod(F.xxhash64(column), parts)).drop("parts")

        def repeated(df: DataFrame) -> DataFrame:
            return df.join(hot, keys, "left").withColumn(part, every).drop("parts")

        if part == "_part":
            many, other = dealt(many, by), repeated(other)
        else:
            many, other = repeated(many), dealt(other, other_by)
    dealt_by = [part for _, part in sides]
    joined = many.join(other, [*keys, *dealt_by], how)
    return (joined if on is None else joined.filter(on)).drop(*dealt_by)
