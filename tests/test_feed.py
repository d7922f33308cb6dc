import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks import sql
from checks.compare import differences
from pressroom.plans import catalog
from pressroom.functions.text import least_length
from pressroom.operators.keywords import word_counts
from pressroom.operators.reading import read_log
from pressroom.operators.summary import sentences
from pressroom.plans.feed import curated_feed
from pressroom.plans.scratch import check_rows, keep, released
from pressroom.plans.skew import spread_join
from pressroom.sources.tables import events
from tests.conftest import SMALL


def test_feed_leaves_out_copies_of_what_was_read(articles, reads, rows):
    story = "storm hits coast and harbour town tonight"
    docs = articles(
        (0, story, "en", "a"), (1, story + " again", "en", "b"), (2, story, "en", "c"),
        (3, "coast guard and harbour police train together", "en", "b"),
        (4, "football cup final tonight", None, "a"),
    )
    feed = curated_feed(docs, reads((1, 0, 2), (2, 0, 4)))
    assert rows(feed, "user_id", "rank", "doc_id") == [(1, 1, 3), (1, 2, 4), (2, 1, 0)]


def test_entry_keeps_its_limits(spark):
    feed = entry(spark).toPandas()
    assert len(feed) and feed["rank"].between(1, 10).all()
    assert not feed.duplicated(["user_id", "lang", "topic", "source"]).any()
    assert feed.groupby(["user_id", "lang", "topic"]).size().max() <= 2
    read = read_log(events(spark, SMALL)).toPandas()
    assert feed.merge(read, on=["user_id", "doc_id"]).empty


def test_names_of_queries_and_sql():
    assert set(catalog.queries()) - set(sql.oracle_sql()) == {"als_recommend"}
    assert set(sql.oracle_sql()) <= set(catalog.queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, name) == ""


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join_with_a_hot_key(spark, rows, how):
    many = keep(spark.range(1000).selectExpr("id", "case when id < 400 then 0 else id % 7 end as k"))
    other = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (99, "d")], "k bigint, v string")
    def text(df):
        return [tuple(map(str, r)) for r in df.select("id", "k", "v").collect()]
    assert sorted(text(spread_join(many, other, ["k"], "id", how=how, share=20, rows=30))) == sorted(
        text(many.join(other, ["k"], how))
    )


def test_spread_join_with_keys_hot_on_both_sides(spark, rows):
    many = keep(spark.range(300).selectExpr("id", "case when id < 100 then 0 else id % 7 end as k"))
    other = keep(spark.range(200).selectExpr("id as v", "case when id < 90 then 0 else id % 9 end as k"))
    dealt = spread_join(many, other, ["k"], "id", share=20, rows=10, other_by="v")
    assert rows(dealt, "id", "k", "v") == rows(many.join(other, "k"), "id", "k", "v")


def test_same_articles_read_in_another_order_give_another_feed(articles, reads, rows):
    docs = articles(
        (0, "harbour storm coast", "en", "a"), (1, "football cup final", "en", "b"),
        (2, "harbour storm warning ships", "en", "c"), (3, "football cup winner goals", "en", "d"),
        (4, "cooking with garden herbs", "en", "e"),
    )
    day = 24 * 60
    log = reads((1, 0, 0), (1, 6 * day, 1), (2, 0, 1), (2, 6 * day, 0))
    feed = rows(curated_feed(docs, log), "user_id", "rank", "doc_id")
    assert feed == [(1, 1, 3), (1, 2, 2), (2, 1, 2), (2, 2, 3)]
    even = rows(curated_feed(docs, log, recent=1), "user_id", "rank", "doc_id")
    assert [r[1:] for r in even if r[0] == 1] == [r[1:] for r in even if r[0] == 2]


def test_korean_words_and_sentences(articles, reads, rows):
    docs = articles(
        (0, "서울 날씨 맑음。 내일 비 옵니다！ 우산 준비하세요？ 모두 안녕", "ko", "a"),
        (1, "서울 날씨 흐림。 모레 눈 옵니다！ 장갑 준비하세요？ 다시 만나요", "ko", "b"),
        (2, "축구 경기 결과。 선수 은퇴…", "ko", "c"),
    )
    counted = {w for _, w, _ in rows(word_counts(docs, least_length(F.col("lang"))))}
    assert {"서울", "날씨"} <= counted and "비" not in counted
    assert [line for d, _, line in rows(sentences(docs)) if d == 2] == ["축구 경기 결과。", "선수 은퇴…"]
    (line,) = curated_feed(docs, reads((1, 0, 0))).collect()
    assert line["doc_id"] == 1 and "장갑" in line["keywords"].split()
    assert line["summary"].startswith("서울 날씨 흐림。 모레 눈 옵니다！")


def test_stored_tables_are_deleted_and_counted(spark, articles, reads, tmp_path, monkeypatch):
    docs = articles("storm hits coast and harbour", "storm and coast guard", "cup final tonight")
    log = reads((1, 0, 0))
    folder, out = tmp_path / "stored", str(tmp_path / "feed")
    monkeypatch.setattr("pressroom.plans.scratch.shared_folder", lambda _: str(folder))
    with released(spark):
        curated_feed(docs, log).write.parquet(out)
        made = len(list(folder.iterdir()))
    assert made and list(folder.iterdir()) == []
    assert spark.read.parquet(out).count() == 1
    check_rows(spark.range(3), 3, "here")
    with pytest.raises(RuntimeError, match="3 rows were written"):
        check_rows(spark.range(2), 3, "here")
