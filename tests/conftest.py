import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from __spark_entry__ import session  # noqa: E402
from pressroom.plans.scratch import keep  # noqa: E402
from pressroom.sources.tables import ARTICLES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def articles(spark):
    """Make an article table from texts, or from (id, text, lang, source)."""

    def make(*rows):
        full = [r if isinstance(r, tuple) else (n, r, "en", f"src{n}") for n, r in enumerate(rows)]
        return keep(
            spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], ARTICLES)
        )

    return make


@pytest.fixture(scope="session")
def reads(spark):
    """Make a read log from (user, minutes after midnight, article)."""

    def make(*rows):
        start = dt.datetime(2024, 1, 1)
        return keep(
            spark.createDataFrame(
                [(n, start + dt.timedelta(minutes=m), u, d) for n, (u, m, d) in enumerate(rows)],
                "event_id bigint, ts timestamp_ntz, user_id bigint, doc_id bigint",
            )
        )

    return make


@pytest.fixture(scope="session")
def rows():
    """The rows of a result as a sorted list of tuples."""
    return lambda df, *cols: sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
