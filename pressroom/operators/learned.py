"""Topics over all languages by spherical k-means, in integers so that a run can be repeated exactly.

An article is the unit vector of its keyword shares, in thousandths; the similarity of two is their product.

1. *Seeding.* Parallel oversampling: one article is drawn at first, and in each round every article of a text of
   its own is drawn with a probability in proportion to its distance from the nearest one drawn so far, so
   that about twice the number of topics come in. After that every article counts for the nearest one drawn, and
   the ``k`` that most count for are the seeds. A round is one pass, however many are drawn.
2. *Rounds.* Articles go to the nearest centre, and the centre becomes the unit vector, in millionths, of the mean.

Draws are hashes of ids, and ties go to the smaller number, so no result depends on the order of rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.text import least_length
from pressroom.operators.duplicates import equal_texts
from pressroom.operators.keywords import keyword_extract, weigh, word_counts
from pressroom.plans.scratch import keep
from pressroom.plans.skew import key_sizes, spread_join

# Lengths of vectors of articles and of centres.
UNIT, CENTRE_UNIT = 1_000, 1_000_000
# Rounds of seeding, and how many times k articles each is to draw.
SEED_ROUNDS, OVERSAMPLE = 2, 2
DRAW_BITS = 52


def unit_terms(keywords: DataFrame) -> DataFrame:
    """``doc_id, w, v``: the keyword shares of each article as a vector of length ``UNIT``."""
    shares = keywords.filter("pm > 0")
    whole = F.sum(F.col("pm") * F.col("pm")).over(Window.partitionBy("doc_id")).cast("double")
    v = F.floor(F.lit(float(UNIT)) * F.col("pm") / F.sqrt(whole)).cast("bigint")
    return shares.select("doc_id", "w", v.alias("v")).filter("v > 0")


class _Terms:
    """The vectors of all articles, and how often each word occurs in them."""

    def __init__(self, terms: DataFrame) -> None:
        self.terms = keep(terms)
        self.sizes = keep(key_sizes(self.terms, ["w"]))

    def nearest(self, centres: DataFrame) -> DataFrame:
        """``doc_id, topic, sim`` of the most similar of ``centres(topic, w, u)``, for articles that share a word with one."""
        met = spread_join(self.terms, centres, ["w"], by="doc_id", sizes=self.sizes)
        best = F.max(F.struct("sim", (-F.col("topic")).alias("t")))
        return (
            met.groupBy("doc_id", "topic")
            .agg(F.sum(F.col("v") * F.col("u")).alias("sim"))
            .groupBy("doc_id")
            .agg(best.alias("b"))
            .select("doc_id", (-F.col("b.t")).alias("topic"), F.col("b.sim").alias("sim"))
        )

    def of(self, chosen: DataFrame) -> DataFrame:
        """``topic, w, u``: the vectors of the articles ``chosen(doc_id, topic)``."""
        return self.terms.join(chosen, "doc_id").select("topic", "w", F.col("v").alias("u"))

    def centres(self, assigned: DataFrame) -> DataFrame:
        """``topic, w, u``: the unit vectors of the means."""
        members = assigned.groupBy("topic").agg(F.count("*").alias("members"))
        means = keep(
            self.terms.join(assigned.select("doc_id", "topic"), "doc_id")
            .groupBy("topic", "w")
            .agg(F.sum("v").alias("s"))
            .join(members, "topic")
            .selectExpr("topic", "w", f"s * {UNIT} div members as c")
            .filter("c > 0")
        )
        lengths = means.groupBy("topic").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("length"))
        u = F.floor(F.lit(float(CENTRE_UNIT)) * F.col("c") / F.col("length")).cast("bigint")
        return means.join(lengths, "topic").select("topic", "w", u.alias("u")).filter("u > 0")


def _draw(seed: int, turn: int) -> Column:
    """A number below 1 for each article, the same in every run."""
    named = F.concat(F.lit(f"{seed}:{turn}:"), F.col("doc_id").cast("string"))
    return F.conv(F.left(F.md5(named), F.lit(DRAW_BITS // 4)), 16, 10).cast("bigint") / F.lit(float(1 << DRAW_BITS))


def drawn(terms: _Terms, firsts: DataFrame, k: int, seed: int) -> DataFrame:
    """``doc_id, topic``: the articles drawn, a few times ``k`` of them; each is a topic by its id."""
    able = keep(terms.terms.select("doc_id").distinct().join(firsts, "doc_id", "left_semi"))
    found = keep(able.orderBy(_draw(seed, 0), "doc_id").limit(1))
    for turn in range(1, SEED_ROUNDS + 1):
        near = terms.nearest(terms.of(found.withColumn("topic", F.col("doc_id"))))
        far = F.greatest(F.lit(0), F.lit(UNIT * UNIT) - F.coalesce("sim", F.lit(0))).cast("double")
        away = keep(able.join(near, "doc_id", "left").select("doc_id", far.alias("d")))
        total = F.lit(away.agg(F.sum("d")).first()[0] or 0.0)
        more = away.filter((F.col("d") > 0) & (_draw(seed, turn) * total < F.lit(float(OVERSAMPLE * k)) * F.col("d")))
        found = keep(found.unionByName(more.select("doc_id")).distinct())
    return found.withColumn("topic", F.col("doc_id"))


def seeds(terms: _Terms, firsts: DataFrame, k: int, seed: int) -> DataFrame:
    """``doc_id, topic``: of the articles drawn, the ``k`` that are nearest to most others, numbered from 1."""
    near = terms.nearest(terms.of(drawn(terms, firsts, k, seed))).join(firsts, "doc_id", "left_semi")
    order = Window.orderBy(F.desc("many"), "doc_id")
    # one row for each of the few articles drawn
    counted = near.groupBy(F.col("topic").alias("doc_id")).agg(F.count("*").alias("many"))
    return counted.select("doc_id", F.row_number().over(order).cast("bigint").alias("topic")).filter(F.col("topic") <= k)


def kmeans_topics(docs: DataFrame, k: int = 20, seed: int = 7, rounds: int = 3) -> DataFrame:
    """``doc_id, topic`` for every article: 1 to ``k``, or 0 where it shares no keyword with any centre."""
    weights = weigh(docs, word_counts(docs, least_length(F.col("lang"))))
    terms = _Terms(unit_terms(keyword_extract(weights, k=20)))
    firsts = equal_texts(docs).filter("doc_id = first_id").select("doc_id")
    centres = keep(terms.of(seeds(terms, keep(firsts), k, seed)))
    for _ in range(rounds - 1):
        centres = keep(terms.centres(keep(terms.nearest(centres))))
    return docs.select("doc_id").join(terms.nearest(centres), "doc_id", "left").select(
        "doc_id", F.coalesce("topic", F.lit(0)).cast("bigint").alias("topic")
    )
