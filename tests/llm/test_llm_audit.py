"""Operator 11 on hand-made rows; larger tables are compared with SQL."""

from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from pressroom.llm.audit import FILTERS, failure_counts, filter_audit, shapley_operator, whole_weights

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    def make(*rows):
        full = [(*r, "src", 1, 7) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, part int, mask int")

    return make


def plain(n):
    return " ".join(f"w{k}" for k in range(n))


def test_operator_is_the_shapley_value():
    weights = shapley_operator(4)
    for f in range(4):
        for s in range(16):
            k = s.bit_count()
            inside = Fraction(factorial(k - 1) * factorial(4 - k), 24) if s >> f & 1 else None
            outside = Fraction(-factorial(k) * factorial(3 - k), 24) if not s >> f & 1 else None
            # the empty coalition removes nothing, so its weight is of no account
            assert s == 0 or weights[f][s] == (inside if inside is not None else outside)


def test_weights_times_the_orders_are_whole_and_efficient():
    table = whole_weights()
    sums = [sum(row[s] for row in table) for s in range(1, 32)]
    assert sums == [0] * 30 + [120]


def by_hand(rows, good, toxic):
    """Every order walked over every document."""
    texts = {}
    for i, text, _ in rows:
        texts.setdefault(text or "", []).append(i)

    def fails(i, text):
        text = text or ""
        ws = text.split()
        first = min((j for j in texts[text] if j is not None), default=None)
        return {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and first < i,
        }

    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, fails(i, t)) for i, t, lang in rows if (lang or "") == part]
        share = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = own
            for n, f in enumerate(order, 1):
                gone = [i for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                share[f] += len(gone)
                out[part, "".join(order), n] = [
                    len(left), len(gone), sum(x[f] for _, x in own) - len(gone),
                    sum(x[f] and sum(x.values()) == 1 for _, x in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = share[row[-1]]
    return out


def test_all_rows_equal_a_walk_by_hand(spark, docs):
    long, shout = plain(200), plain(250) + " " + "CAPITALS " * 10
    rows = [
        (0, long, "en"), (1, long, "de"), (2, long, "en"), (3, shout, "en"), (4, None, None), (5, "", ""), (6, None, "en"),
        (7, "a a a a " * 60, "en"), (8, long + " 50 %", "en"), (9, shout, "en"), (10, "a" * 5000, "en"), (None, long, "en"),
        (None, "x|y", "de"), (11, "x|y", "de"), (11, "x|y", "de"), (12, "x|y", "fr"), (13, "Große Ängste", "fr"),
    ]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, None, 1), (4, 1, None), (None, 1, 1), (99, 1, 1)], LABELS)
    found = filter_audit(docs(*rows), labels).collect()
    wanted = by_hand(rows, {1, 2, 4}, {2, 9})
    assert len(found) == len(wanted) == 120 * 5 * 4
    for r in found:
        got = [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        assert got == wanted[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)


def test_copies_are_counted_without_a_row_for_each(spark, docs):
    rows = docs(*[(i, plain(210), "en") for i in range(500)])
    counts = failure_counts(rows, spark.createDataFrame([], LABELS)).collect()
    assert sorted((r.mask, r.n) for r in counts) == [(0, 1), (16, 499)]


def test_empty_table(spark, docs):
    assert filter_audit(docs((1, "", "")).limit(0), spark.createDataFrame([], LABELS)).count() == 0

