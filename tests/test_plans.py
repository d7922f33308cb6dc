import sys

from pressroom.plans import scratch
from pressroom.plans.catalog import queries
from tests.conftest import SMALL


def test_no_step_of_the_feed_needs_a_cross_join_or_python_rows(spark, monkeypatch, capsys):
    def explained(df):
        df.explain()
        return scratch.keep(df)

    for name, module in list(sys.modules.items()):
        if name.startswith("pressroom.") and module is not scratch and hasattr(module, "keep"):
            monkeypatch.setattr(module, "keep", explained)
    queries()["curated_feed"](spark, SMALL).explain()
    plans = capsys.readouterr().out
    assert plans.count("== Physical Plan ==") > 20
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in plans


def test_read_log_filter_and_columns_reach_the_scan(spark, capsys):
    queries()["read_sessions"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "In(event_type, [click,view])" in plan and "value" not in plan.split("ReadSchema")[1].split(">")[0]


def test_top_keywords_are_cut_before_the_shuffle(spark, capsys):
    queries()["keyword_extract"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
