"""A mix of sources with given weights, drawn in blocks of words.

The words of a source, its documents in pseudorandom order, are packed into blocks of ``block``
words. The output is a row of shards of ``shard`` slots. For each shard the number of slots of each
source is drawn: the whole part of what it should get is fixed, the rest is a multinomial draw, so
that a source stays close to its target in every shard. The slots of a source are numbered through
all shards; number k takes block ``perm(k mod blocks)`` of pass ``k div blocks``, with a
pseudorandom permutation for each source and pass, and slots and blocks are joined on that index.
A source has at most ``most`` passes, so nothing is taken more often.

Weights go by code point order of the source names, null last: 5, 2, 1, repeating. A target stops
at ``most`` times the size of its source and the excess is shared by weight among the others.

Everything random is an md5 of ids and ``seed``: reruns and lost tasks give the same mix.

Defined results: a null text has no words, a null source is a source of its own, an empty table
gives an empty mix. Repeated rows are packed one after the other and have a result each. Only
``doc_id``, ``text`` and ``source`` are looked at. The table of sources has one row for each
source and is ordered as a whole; everything that grows with documents or words is spread.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.plans.scratch import keep

# Weights in order of the sources, and primes above any likely number of blocks.
WEIGHTS = (5, 2, 1)
PRIMES = (2147483659, 2147483693)
CELLS = 4096
GAP = r"[\x20\x09-\x0D]+"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an md5, the same in any engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def word_count(text: str = "text") -> Column:
    """Without building a list of words twice: the text between two marks, cut at white space."""
    whole = F.concat(F.lit("x "), F.coalesce(text, F.lit("")), F.lit(" x"))
    return (F.size(F.split(whole, GAP)) - 2).cast("bigint")


def before(df: DataFrame, by: str, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` of the rows of the same ``by`` before this one.

    Totals of ``part`` come first, so no task has to hold all rows of one ``by``.
    """
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, part).agg(F.sum(value).alias("_t"))
    totals = totals.select(by, part, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, [by, part])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_before")
    )


def source_targets(sized: DataFrame, most: int = 3, block: int = 32) -> DataFrame:
    """``sid, source, source_size, w, target, blocks, total``: one row per source, numbered from 0."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = named.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("sid") % len(WEIGHTS))
    named = named.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy(F.lit(1))
    by_cap = every.orderBy(F.col("cap") / F.col("w"), "sid")
    full = (
        named.withColumn("total", F.sum("source_size").over(every))
        .withColumn("lower", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        # taken in order of cap by weight, a source is full if an even share of what is left reaches its cap
        .withColumn("full", F.col("cap") * F.col("open") <= (F.col("total") - F.col("lower")) * F.col("w"))
    )
    rest = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    shares = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("w") * ((F.col("total") - F.col("_rest")) / F.col("_shares"))
    )
    return (
        full.withColumn("_rest", rest)
        .withColumn("_shares", shares)
        .select("sid", "source", "source_size", "w", target.alias("target"),
                F.ceil(F.col("source_size") / block).alias("blocks"), "total")
    )


def packed(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id, source, size, h``: every row with its size and its place in the order of its source."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))).cast("binary"))
    return keep(docs.select("doc_id", "source", word_count().alias("size"), h.alias("h")))


def shard_draws(sources: DataFrame, shard: int, block: int, seed: str) -> DataFrame:
    """``sid, shard, group, n``: how many slots of each shard a source gets."""
    live = sources.filter("source_size > 0").withColumn("slots", F.round(F.col("total") / block).cast("bigint"))
    whole = F.struct((F.col("slots") / shard).cast("bigint").alias("shards"), F.lit(0).cast("bigint").alias("first"), F.lit(shard).cast("bigint").alias("per"))
    last = F.struct(F.lit(1).cast("bigint").alias("shards"), (F.col("slots") / shard).cast("bigint").alias("first"), (F.col("slots") % shard).alias("per"))
    kinds = (
        live.select("sid", "target", "total", F.explode(F.array(whole, last)).alias("kind"))
        .select("sid", "target", "total", "kind.*")
        .filter("shards > 0 and per > 0")
        .withColumn("mean", F.col("per") * F.col("target") / F.col("total"))
        .withColumn("fixed", F.floor("mean"))
        .withColumn("rest", F.col("mean") - F.col("fixed"))
    )
    by_kind = Window.partitionBy("first")
    up_to = by_kind.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    kinds = keep(
        kinds.withColumn("sum", F.sum("rest").over(by_kind.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("hi", F.when(F.col("sum") > 0, F.sum("rest").over(up_to) / F.col("sum")).otherwise(0.0))
        .withColumn("draws", F.col("per") - F.sum("fixed").over(by_kind))
        .withColumn("lo", F.coalesce(F.lag("hi").over(by_kind.orderBy("sid")), F.lit(0.0)))
    )
    fixed = kinds.filter("fixed > 0").select("sid", F.explode(F.expr("sequence(first, first + shards - 1)")).alias("shard"), F.col("fixed").alias("n"))
    tosses = (
        kinds.groupBy("first", "shards", "draws").agg(F.count("*"))
        .filter("draws > 0")
        .select("first", "draws", F.explode(F.expr("sequence(first, first + shards - 1)")).alias("shard"))
        .select("first", "shard", F.explode(F.expr("sequence(1, draws)")).alias("toss"))
        .withColumn("u", uniform(F.lit(seed), F.col("shard"), F.col("toss")))
        .withColumn("cell", F.floor(F.col("u") * CELLS))
    )
    # a draw finds its source by a guide table: cells of [0, 1), each with the sources that touch it
    top = F.floor(F.col("hi") * CELLS)
    guide = kinds.filter("rest > 0").select(
        "first", "sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(top, F.lit(CELLS - 1)))).alias("cell")
    )
    drawn = tosses.join(guide, ["first", "cell"]).filter("u >= lo and u < hi").select("sid", "shard", F.lit(1).cast("bigint").alias("n"))
    return (
        fixed.unionByName(drawn).groupBy("sid", "shard").agg(F.sum("n").alias("n"))
        .withColumn("group", F.floor(F.col("shard") / CELLS))
    )


def mix_slots(sources: DataFrame, block: int = 32, shard: int = 1024, most: int = 3, seed: str = "mix") -> DataFrame:
    """``sid, shard, k, pass, block``: every slot of the mix and the block that fills it."""
    draws = before(shard_draws(sources, shard, block, seed), "sid", "group", ["shard"], "n", "from")
    perm = sources.filter("blocks > 0").select("sid", "blocks")
    slots = draws.join(perm, "sid").select("sid", "blocks", "shard", F.explode(F.expr("sequence(from, from + n - 1)")).alias("k"))
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).filter(F.col("pass") < most)
    prime = F.when(F.col("blocks") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1]))
    shift = F.floor(uniform(F.lit(seed), F.lit("shift"), F.col("sid"), F.col("pass")) * F.col("blocks"))
    # a prime that does not divide the number of blocks, times k, plus a shift: each block once in a pass
    at = (F.col("k") % F.col("blocks")).cast("decimal(18,0)") * prime.cast("decimal(18,0)") + shift.cast("decimal(18,0)")
    return slots.select("sid", "shard", "k", "pass", (at % F.col("blocks").cast("decimal(18,0)")).cast("bigint").alias("block"))


def mix(docs: DataFrame, block: int = 32, shard: int = 1024, most: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(places, slots, sources)``: which words of which document lie in which block, the slots, the targets.

    ``places`` has ``doc_id, sid, size, row, block, words``: a row for each block that a document
    lies in, and one with null ``block`` for a document without words; ``row`` numbers the
    documents of a source. Joined with ``slots`` on ``sid, block`` it is the mix itself.
    """
    sized = packed(docs, seed)
    sources = keep(source_targets(sized, most, block))
    numbered = sized.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(
        sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), "sid"), "_s"
    ).drop("_s")
    numbered = numbered.withColumn("part", F.substring("h", 1, 4))
    inside = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size")
    offs = before(numbered, "sid", "part", ["h", "doc_id", "size"], "size", "off").withColumn("rn", F.row_number().over(inside))
    blocks = F.when(F.col("size") > 0, F.expr(f"sequence(off div {block}, (off + size - 1) div {block})"))
    places = offs.select("doc_id", "sid", "size", F.concat("part", F.lit(":"), "rn").alias("row"), "off", F.explode_outer(blocks).alias("block"))
    words = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("off"), F.col("block") * block)
    return places.withColumn("words", words), mix_slots(sources, block, shard, most, seed), sources


def mixed_documents(docs: DataFrame, block: int = 32, shard: int = 1024, most: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row: what the mix takes of it."""
    places, slots, sources = mix(docs, block, shard, most, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = (
        places.join(times, ["sid", "block"], "left")
        .groupBy("sid", "row", "doc_id", "size")
        .agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken"))
    )
    return taken.join(sources.select("sid", "source", "source_size", "target"), "sid").select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken")
    )
