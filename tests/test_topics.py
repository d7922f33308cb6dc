from pressroom.operators.keywords import article_totals, keyword_extract, weigh, word_counts
from pressroom.operators.duplicates import equal_texts
from pressroom.operators.learned import kmeans_topics
from pressroom.operators.topics import diverse_perspectives, perspectives, topic_group, topic_labels
from pressroom.plans.scratch import keep
from tests.conftest import SMALL


def test_articles_join_the_topic_they_share_words_with(articles, rows):
    docs = articles(
        (0, "goal goal match match team team", "en", "a"),
        (1, "vote vote party party law law", "en", "b"),
        (2, "match team", "en", "a"),
        (3, "party law vote", "en", "c"),
        (4, "unrelated", "en", "a"),
        (5, "match but french", "fr", "a"),
    )
    weights = keep(weigh(docs, word_counts(docs)))
    kw = keep(keyword_extract(weights, k=20))
    found = keep(topic_group(docs, kw, article_totals(weights), keep(equal_texts(docs)), k=2))
    # the politics words are in as many articles as the sport words, bar "goal", which is rarer
    assert rows(found) == [
        (0, "en", 1), (1, "en", 2), (2, "en", 1), (3, "en", 2), (4, "en", 0), (5, "fr", 1),
    ]
    labels = rows(topic_labels(found, kw, k=1), "lang", "topic", "w")
    assert [(lang, topic) for lang, topic, _ in labels] == [("en", 1), ("en", 2), ("fr", 1)]


def test_perspectives_name_an_outlet_once_per_topic(spark, articles, rows):
    docs = articles((0, "x", "en", "a"), (1, "x", "en", "a"), (2, "x", "en", "b"), (3, "x", "fr", "a"))
    topics = spark.createDataFrame([(n, "en" if n < 3 else "fr", 1) for n in range(4)],
                                   "doc_id bigint, lang string, topic bigint")
    totals = spark.createDataFrame([(0, 5), (1, 5), (2, 7)], "doc_id bigint, total bigint")
    assert rows(perspectives(docs, topics, totals)) == [
        ("en", 1, "a", 0, 5, 2), ("en", 1, "b", 2, 7, 1), ("fr", 1, "a", 3, 0, 1),
    ]
    assert rows(perspectives(docs, topics, totals, n=1), "doc_id") == [(2,), (3,)]


def test_kmeans_gives_equal_texts_one_topic(spark):
    from pressroom.sources.tables import articles as read

    docs = read(spark, SMALL)
    found = kmeans_topics(docs, k=5).join(docs, "doc_id")
    assert found.count() == docs.count()
    assert found.groupBy("text").agg({"topic": "min"}).count() == found.select("text", "topic").distinct().count()


def test_kmeans_splits_the_articles_and_takes_no_rows(spark, articles):
    from pressroom.sources.tables import articles as read

    docs = read(spark, "/root/testdata/sf0.01")
    sizes = {r.topic: r["count"] for r in kmeans_topics(docs).groupBy("topic").count().collect()}
    assert set(sizes) <= set(range(21)) and max(sizes.values()) < sum(sizes.values()) / 2
    assert kmeans_topics(articles("a", "b").limit(0)).count() == 0
    assert [r.topic for r in kmeans_topics(articles("", None)).collect()] == [0, 0]


def test_kmeans_keeps_apart_what_shares_no_word(spark, articles):
    sport = ["goal match team", "match team cup", "team cup goal"]
    law = ["vote party court", "party court judge", "court judge vote"]
    found = {r.doc_id: r.topic for r in kmeans_topics(articles(*sport, *law, "goal match team"), k=6).collect()}
    assert found[0] == found[6] > 0
    assert not {found[n] for n in (0, 1, 2)} & {found[n] for n in (3, 4, 5)} - {0}


def perspective_rows(spark, rows, given, n=10):
    """``given`` has (id, outlet, {word: share}); all are of one topic, but those of lang fr of another."""
    kws = "doc_id bigint, lang string, kws array<struct<w:string,pm:bigint>>"
    cards = spark.createDataFrame([(i, None, list(k.items())) for i, _, k in given], kws)
    docs = spark.createDataFrame([(i, o) for i, o, _ in given], "doc_id bigint, source string")
    topics = spark.createDataFrame([(i, "fr" if i >= 90 else None, 1) for i, _, _ in given], "doc_id bigint, lang string, topic bigint")
    return [r[1:] for r in sorted((r.rk, r.doc_id, r.score) if r.lang is None else (99 + r.rk, r.doc_id, r.score)
                                  for r in diverse_perspectives(cards, docs, topics, n).collect())]


def test_an_article_with_new_words_beats_the_heaviest_of_its_outlet(spark, rows):
    given = [
        (1, "a", {"x": 500, "y": 400}), (2, "b", {"x": 500, "y": 350, "z": 10}), (3, "b", {"v": 200, "w": 100}),
        (4, "c", {"x": 500, "y": 400}), (5, None, {"v": 200, "u": 50}), (6, None, {"t": 40}),
    ]
    # 2 is the heaviest of outlet b, but adds 10 only; 4 is a copy of 1 and adds nothing; 5 and 6 are of one outlet
    assert perspective_rows(spark, rows, given) == [(1, 900), (3, 300), (5, 50)]
    assert perspective_rows(spark, rows, given, n=1) == [(1, 900)]


def test_topics_take_perspectives_each_for_itself(spark, rows):
    given = [(1, "a", {"x": 5}), (2, "b", {"x": 5}), (90, "a", {"x": 5}), (91, "a", {"y": 9}), (92, "b", {"x": 5})]
    assert perspective_rows(spark, rows, given) == [(1, 5), (91, 9), (92, 5)]
