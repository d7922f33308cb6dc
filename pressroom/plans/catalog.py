"""Every operator as a query over the tables of a folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.text import least_length
from pressroom.operators import duplicates, factors, interest, keywords, learned, links, reading, recommend, summary, together, topics
from pressroom.plans import feed
from pressroom.plans.scratch import keep
from pressroom.sources import tables


class Steps:
    """The steps that several queries share, each stored once for the query at hand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.docs = tables.articles(spark, folder)
        self.min_len = least_length(F.col("lang"))
        self.reads = reading.read_log(tables.events(spark, folder))

    def weights(self) -> DataFrame:
        return keywords.weigh(self.docs, keywords.word_counts(self.docs, self.min_len))

    def weighted_terms(self) -> DataFrame:
        return keywords.weigh(self.docs, keywords.article_terms(self.docs, self.min_len))

    def keywords(self) -> DataFrame:
        return keep(keywords.keyword_extract(self.weights(), k=20))

    def copies(self) -> DataFrame:
        return keep(duplicates.equal_texts(self.docs))

    def duplicate_groups(self) -> DataFrame:
        return duplicates.duplicate_groups(self.docs, self.copies())

    def interest(self, kw: DataFrame) -> DataFrame:
        return interest.interest_profile(self.reads, kw)

    def topics(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Topics, keywords and article totals."""
        weights = keywords.keep_words(self.weights())
        kw = keep(keywords.keyword_extract(weights, k=20))
        totals = keywords.article_totals(weights)
        return topics.topic_group(self.docs, kw, totals, self.copies()), kw, totals


def _topic_rounds(s: Steps) -> DataFrame:
    weights = keywords.keep_words(s.weights())
    cards = keep(topics.article_cards(s.docs, keywords.keyword_extract(weights, k=20)))
    seeds = topics.topic_seeds(s.docs, cards, keywords.article_totals(weights), s.copies())
    return topics.topic_rounds(cards, seeds)


def _interest_match(s: Steps) -> DataFrame:
    kw = s.keywords()
    return recommend.interest_match(s.interest(kw), kw)


def _recommend(s: Steps) -> DataFrame:
    kw = s.keywords()
    return recommend.recommend(s.interest(kw), kw, s.reads)


def _unread(s: Steps) -> DataFrame:
    """Of all that is read together with a user's articles, what the user has not read."""
    return recommend.unread(together.neighbour_offers(s.reads), s.reads)


def _topic_labels(s: Steps) -> DataFrame:
    found, kw, _ = s.topics()
    return topics.topic_labels(keep(found), kw)


def _perspectives(s: Steps) -> DataFrame:
    found, kw, _ = s.topics()
    return topics.diverse_perspectives(topics.article_cards(s.docs, kw), s.docs, keep(found))


def _limit_feed(s: Steps) -> DataFrame:
    """Within the limits, the best of all unread articles of each user."""
    found, kw, _ = s.topics()
    labels = keep(
        s.docs.select("doc_id", "source").join(found, "doc_id").withColumn("lang", F.coalesce("lang", F.lit("")))
    )
    seen = keep(s.reads.select("user_id", "doc_id").distinct())
    fed = recommend.matches(s.interest(kw), kw, seen, feed.feed_levels(2, 1, 10), labels)
    return fed.withColumnRenamed("rk", "rank").select(
        "user_id", "doc_id", "score", "lang", "topic", "source", "rank"
    )


_QUERIES: dict[str, Callable[[Steps], DataFrame]] = {
    "curated_feed": lambda s: feed.curated_feed(s.docs, s.reads),
    "three_line_summary": lambda s: summary.three_line_summary(s.docs, s.weighted_terms()),
    "keyword_extract": lambda s: keywords.keyword_extract(s.weights()),
    "reading_pattern": lambda s: reading.reading_pattern(s.reads),
    "interest_profile": lambda s: s.interest(s.keywords()),
    "recommend": _recommend,
    "topic_group": lambda s: s.topics()[0],
    "remove_duplicates": lambda s: duplicates.remove_duplicates(s.docs, keep(s.duplicate_groups())),
    "perspectives": _perspectives,
    "word_counts": lambda s: keywords.word_counts(s.docs, s.min_len),
    "sentences": lambda s: summary.sentences(s.docs),
    "word_weights": lambda s: s.weights(),
    "sentence_scores": lambda s: summary.sentence_scores(s.docs, s.weighted_terms()),
    "read_log": lambda s: s.reads,
    "read_sessions": lambda s: reading.read_sessions(s.reads),
    "reading_times": lambda s: reading.reading_times(s.reads),
    "interest_match": _interest_match,
    "unread": _unread,
    "next_read": lambda s: reading.next_read(s.reads),
    "read_together": lambda s: together.read_together(s.reads),
    "als_recommend": lambda s: factors.als_recommend(s.reads),
    "shingles": lambda s: duplicates.shingle_rows(s.docs),
    "near_links": lambda s: links.near_links(s.docs, s.copies()),
    "duplicate_groups": lambda s: s.duplicate_groups(),
    "topic_rounds": _topic_rounds,
    "kmeans_topics": lambda s: learned.kmeans_topics(s.docs),
    "topic_labels": _topic_labels,
    "limit_feed": _limit_feed,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name of the query -> what runs it on ``(spark, folder)``."""

    def on_folder(query: Callable[[Steps], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(Steps(spark, folder))

    return {name: on_folder(query) for name, query in _QUERIES.items()}
