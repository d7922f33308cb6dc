"""Benchmark passages in documents: a prefix-filtered set join, then an exact test.

A word is a run of digits, letters a-z or characters outside ASCII, A-Z lower-cased. Every
``width`` consecutive words of a benchmark item are a window; an item of fewer words, but not none,
is one window. A document holds a window if the words stand in it in the same order without gaps.

The words of a window are ordered by how rare they are in all documents. A document that contains
the whole window has every one of its words, so the necessary prefix is one word, the rarest. Only
places of these words are joined; the place gives where the window must begin, which has to lie
within the document (positional bound) with room for the whole window (length bound); then the
words are compared.

Defined results: null and empty texts have no words and hold nothing; items without words have no
window. Windows of an item whose ``item_id`` is null count as hits but name no item. Repeated rows
each get their result. Empty tables give empty results or no hits. Only ``doc_id``, ``text``,
``item_id`` are looked at.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.rows import UPPER, ascii_lower, row_key, without
from pressroom.plans.scratch import keep

# Fixed value: a word before A-Z are lower-cased. The same as `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, which takes Java
# twelve times as long: it tries each range that is ruled out at every character.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
# Windows are broadcast only up to so many characters in all; beyond that they are joined by a shuffle.
BROADCAST_CHARS = 32_000_000


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``window, items``: each different window once, as words joined by spaces."""
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    items = benchmark.select("item_id", lowered.alias("text")).select("item_id", words().alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))
    return (
        items.select("item_id", "ws", F.explode(starts).alias("s"))
        .select("item_id", F.array_join(F.slice("ws", F.col("s"), width), " ").alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )


def rare_prefixes(docs: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """``token, ahead, len, window, items``: the rarest word of each window and the words before it."""
    split = found.withColumn("ws", F.split("window", " "))
    vocabulary = split.select(F.explode("ws").alias("token")).distinct()
    places = docs.select(F.explode(words()).alias("raw")).select(ascii_lower(F.col("raw")).alias("token"))
    counts = keep(
        places.join(F.broadcast(vocabulary) if small else vocabulary, "token")
        .groupBy("token")
        .agg(F.count("*").alias("uses"))
    )
    by_rarity = Window.partitionBy("window").orderBy("uses", "token", "ahead")
    return (
        split.select("window", "items", F.size("ws").alias("len"), F.posexplode("ws").alias("ahead", "token"))
        .join(F.broadcast(counts) if small else counts, "token", "left")
        .na.fill(0, ["uses"])
        .withColumn("rk", F.row_number().over(by_rarity))
        # a word that no document has rules the window out
        .filter("rk = 1 and uses > 0")
        .select("token", "ahead", "len", "window", "items")
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``row, doc_id, start, stop, items``: where documents hold windows, in words from 0."""
    found = keep(windows(benchmark, width))
    chars = found.agg(F.sum(F.length("window"))).first()[0] or 0
    small = chars <= broadcast_chars
    prefixes = keep(rare_prefixes(docs, found, small))
    here = docs.select("doc_id", row_key().alias("row"), words().alias("ws"))
    if small:
        # The join needs no shuffle and no copy of the words: only places that pass it are written out.
        at = here.select("doc_id", "row", "ws", F.posexplode("ws").alias("pos", "raw"))
        lead = F.lit(0)
    else:
        # Each place takes along the words around it, which is all that a window there can cover.
        lead = F.greatest(F.col("pos") - (width - 1), F.lit(0))
        at = here.select("doc_id", "row", "ws", F.posexplode("ws").alias("pos", "raw")).select(
            "doc_id", "row", "pos", "raw", F.slice("ws", lead + 1, 2 * width - 1).alias("ws")
        )
    start = F.col("pos") - F.col("ahead")
    met = at.withColumn("token", ascii_lower(F.col("raw"))).join(F.broadcast(prefixes) if small else prefixes, "token")
    inside = (start >= 0) & (start - lead + F.col("len") <= F.size("ws"))
    same = ascii_lower(F.array_join(F.slice("ws", F.greatest(start - lead, F.lit(0)) + 1, F.col("len")), " ")) == F.col("window")
    return met.filter(inside & same).select(
        "row", "doc_id", start.alias("start"), (start + F.col("len")).alias("stop"), "items"
    )


def covered(spans: Column) -> Column:
    """How many places sorted ``start, stop`` spans cover in all."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))

    def step(so_far: Column, span: Column) -> Column:
        more = F.greatest(span["stop"] - F.greatest(span["start"], so_far["to"]), F.lit(0))
        return F.struct((so_far["n"] + more).alias("n"), F.greatest(so_far["to"], span["stop"]).alias("to"))

    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``row, doc_id, n_words, n_hit, items, spans`` for every row; arrays are null without hits."""
    hits = (
        occurrences(docs, benchmark, width, broadcast_chars)
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select("row", "items", "spans", covered(F.col("spans")).alias("n_hit"))
    )
    every = docs.select(row_key().alias("row"), "doc_id", F.size(words()).cast("bigint").alias("n_words"))
    return every.join(hits, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, all columns as they were."""
    return without(docs, row_key(), keep(occurrences(docs, benchmark, width).select("row").distinct()))
