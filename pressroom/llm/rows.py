"""Small helpers that the operators on documents share."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# How many different values a bucket filter broadcasts at most, whatever the size of the data.
BUCKETS = 1 << 20


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row that is never null; equal only for rows of equal id and text.

    The text enters as a 64-bit hash next to the id, so only rows of one id could be mistaken.
    """
    shown = F.coalesce(F.col(doc_id).cast("string"), F.lit("~"))
    return F.concat(shown, F.lit("/"), F.hex(F.xxhash64(text)))


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and every other character as it is.

    ``lower`` is quick, but also changes letters outside ASCII; ``translate`` does not, but is slow.
    """
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def bucket(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until it is no column of ``frames``, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_buckets_of(df: DataFrame, keys: Iterable[Column | str], wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose keys fall into the same bucket as some row of ``wanted``.

    ``wanted`` has one column ``bucket``, made by ``bucket``. At most ``BUCKETS`` integers are
    broadcast. Every wanted row passes, and some others: a cheap first sieve without a shuffle,
    to be followed by an exact step.
    """
    place = unused("_bucket", df)
    few = F.broadcast(wanted.distinct().withColumnRenamed("bucket", place))
    return df.withColumn(place, bucket(*keys)).join(few, place, "left_semi").drop(place)


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``key`` is the only column of some row of ``gone``, a stored table.

    Rows in no bucket of ``gone`` stay where they lie; only the others, with their texts, are shuffled.
    """
    name, place = unused("_key", docs), unused("_bucket", docs)
    gone = gone.toDF(name)
    few = F.broadcast(gone.select(bucket(name).alias(place)).distinct())
    marked = docs.withColumn(name, key).withColumn(place, bucket(name))
    safe = marked.join(few, place, "left_anti")
    open_rows = marked.join(few, place, "left_semi").join(gone, name, "left_anti")
    return safe.drop(name, place).unionByName(open_rows.drop(name, place))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
