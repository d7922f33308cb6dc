"""How filters interact: what each removes alone, after others, and on average over all orders.

Five filters look at a document; the letter of a filter is its name in an order.

- ``A`` it has fewer than 200 words,
- ``B`` fewer than half of its words are distinct,
- ``C`` more than 3 of 100 code points are A-Z,
- ``D`` it holds one of ``#$%&*|``,
- ``E`` its text is that of a document of smaller id, anywhere in the table.

Words are runs of characters other than white space, case-sensitive; a null text counts as empty.

1. Every document gives a mask of the filters it fails. Rows are counted by text and mask before
   copies are looked at, so a group of copies is a few rows, however large it is.
2. The 32 coalitions of filters are tabulated for each part: how many documents a coalition
   removes, whatever the order in it. Every figure of a step is a difference of two coalitions.
3. What a filter removes on average over all orders is its Shapley value. Of all additive models
   of the 32 removals it is the one with the least squared error, weighted by the kernel
   ``(n - 1) / (C(n, s) * s * (n - s))`` for coalitions of ``s`` filters, under the constraint that the
   filters together remove what the full coalition removes. Those normal equations are solved in
   fractions, once for each coalition as right-hand side, as they are linear in the removals; the
   solution times 120 is a whole number for each, so the sums over coalitions are exact.

Defined results: a null ``lang`` is the part of the empty string. A document of a null id has no smaller
and is smaller than none, and has no labels. Rows that repeat an id count one by one and are no copies
of each other. Of several labels of an id, any 1 counts. An empty table gives an empty result. Only ``doc_id``,
``text`` and ``lang`` and the labels' ``doc_id``, ``quality`` and ``toxic`` are read.
"""

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.plans.scratch import keep

# The filters and what they fail on.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
FEWEST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
MARKS = r"[#$%&*|]"

COALITIONS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failed_on_its_own(text: Column) -> Column:
    """The mask of the filters other than ``E`` that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def mask(ws: Column) -> Column:
        n = F.size(ws)
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = {
            "A": n < FEWEST_WORDS,
            "B": 100 * F.size(F.array_distinct(ws)) < DISTINCT_PERCENT * n,
            "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
            "D": text.rlike(MARKS),
        }
        masks = [F.when(failed, F.lit(bit(name))).otherwise(0) for name, failed in fails.items()]
        return sum(masks[1:], masks[0])

    return F.get(F.transform(F.array(words), mask), F.lit(0))


def labelled_once(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic``: one row per labelled id."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters they fail, at most 32 rows a part."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        failed_on_its_own(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("h"),
    )
    kind = ["h", "part", "mask", "good", "toxic"]
    # Both steps need the rows of an id together, so the second has no shuffle of its own.
    ids = (
        narrow.join(labelled_once(labels), "doc_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
        .groupBy("doc_id", *kind)
        .agg(F.count("*").alias("c"))
    )
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    kinds = keep(
        ids.withColumn("named", F.col("doc_id").isNotNull())
        .groupBy(*kind, "named")
        .agg(F.sum("c").alias("n"), least.alias("least"))
        .select(*kind, "named", "n", F.col("least.doc_id").alias("id"), F.col("least.c").alias("at_id"))
    )
    firsts = kinds.filter("named").groupBy("h").agg(F.min("id").alias("first"), F.sum("n").alias("rows"))
    # A text of one row has no copy: it needs no join.
    first_of = firsts.filter("rows > 1").select("h", "first")
    copies = F.when(
        F.col("named") & F.col("first").isNotNull(),
        F.col("n") - F.when(F.col("id") == F.col("first"), F.col("at_id")).otherwise(0),
    ).otherwise(0)
    split = kinds.join(first_of, "h", "left").withColumn("copies", copies)
    both = F.array(
        F.struct("mask", (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n")),
    )
    return (
        split.select("part", "good", "toxic", F.inline(both))
        .filter("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def coalition_removals(counts: DataFrame) -> DataFrame:
    """``part, total, removed, good, toxic``: per part, arrays of what each of the 32 coalitions removes.

    The place in an array is the mask of the coalition.
    """
    rows = F.collect_list(F.struct("mask", "n", "good", "toxic"))

    def removed(name: str) -> Column:
        def of(coalition: Column) -> Column:
            hit = F.filter("rows", lambda r: r["mask"].bitwiseAND(coalition) != 0)
            return F.aggregate(hit, F.lit(0).cast("bigint"), lambda s, r: s + r[name])

        return F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), of)

    return (
        counts.groupBy("part")
        .agg(rows.alias("rows"), F.sum("n").alias("total"))
        .select("part", "total", removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))
    )


def _solved(matrix: list[list[Fraction]], sides: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solution for every column of ``sides``, by elimination in fractions."""
    rows = [[*left, *right] for left, right in zip(matrix, sides, strict=True)]
    for k in range(len(rows)):
        pivot = next(r for r in range(k, len(rows)) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(len(rows)):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[len(matrix):] for row in rows]


def shapley_operator(n: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each of ``n`` filters the weight of every coalition's removal in its Shapley value.

    Least squares over all coalitions but the empty and the full one, with the kernel as weights, and a
    multiplier for the constraint that the values sum to the removal of the full coalition.
    """
    full = (1 << n) - 1
    inside = [[(s >> f) & 1 for f in range(n)] for s in range(full + 1)]

    def weight(s: int) -> Fraction:
        k = sum(inside[s])
        return Fraction(n - 1, comb(n, k) * k * (n - k))

    proper = range(1, full)
    normal = [[sum(weight(s) * inside[s][f] * inside[s][g] for s in proper) for g in range(n)] + [Fraction(1)] for f in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    sides = [[weight(s) * inside[s][f] if 0 < s < full else Fraction(0) for s in range(full + 1)] for f in range(n)]
    sides.append([Fraction(s == full) for s in range(full + 1)])
    return _solved(normal, sides)[:n]


def whole_weights() -> list[list[int]]:
    """``shapley_operator`` times the number of orders, in which it has no fractions left."""
    orders = factorial(len(FILTERS))
    scaled = [[w * orders for w in row] for row in shapley_operator()]
    assert all(w.denominator == 1 for row in scaled for w in row)
    return [[int(w) for w in row] for row in scaled]


def _coalition(names: Column) -> Column:
    """The mask of the filters named in a string."""
    masks = [F.when(F.contains(names, F.lit(name)), F.lit(bit(name))).otherwise(0) for name in FILTERS]
    return sum(masks[1:], masks[0])


def _with_steps(table: DataFrame) -> DataFrame:
    """Each row once per order and step, with the filter's place and the coalitions before and after the step."""
    orders = " ".join("".join(order) for order in permutations(FILTERS))
    order, step = F.col("filter_order"), F.col("step")
    return (
        table.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .select(
            "*",
            (F.position(F.substr(order, step, F.lit(1)), F.lit(FILTERS)) - 1).alias("f"),
            _coalition(F.left(order, step - 1)).alias("before"),
            _coalition(F.left(order, step)).alias("after"),
        )
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    whole = COALITIONS - 1
    # Stored, as every figure below reads these arrays anew.
    table = keep(coalition_removals(failure_counts(docs, labels)))

    def at(name: str, place: Column | int) -> Column:
        return F.get(name, place if isinstance(place, Column) else F.lit(place))

    def value(weights: list[int]) -> Column:
        terms = [at("removed", s) * F.lit(w).cast("bigint") for s, w in enumerate(weights) if w]
        return sum(terms[1:], terms[0])

    per_filter = F.array(*[
        F.struct(
            at("removed", 1 << f).alias("fails"),
            (at("removed", whole) - at("removed", whole - (1 << f))).alias("unique_fails"),
            value(weights).alias("shapley"),
        )
        for f, weights in enumerate(whole_weights())
    ])
    each = _with_steps(table.withColumn("filters", per_filter)).withColumn("of", F.get("filters", F.col("f")))

    def step_of(name: str) -> Column:
        return at(name, F.col("after")) - at(name, F.col("before"))

    return each.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("removed", F.col("after"))).alias("kept"),
        step_of("removed").alias("removed"),
        (F.col("of.fails") - step_of("removed")).alias("redundant"),
        F.col("of.unique_fails").alias("unique_fails"),
        step_of("good").alias("good_lost"),
        step_of("toxic").alias("toxic_lost"),
        F.col("of.shapley").alias("shapley"),
    )
