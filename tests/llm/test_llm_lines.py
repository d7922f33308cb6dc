"""Operator 12 on hand-made rows and against a brute-force version; larger tables are compared with SQL."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressroom.llm.line_dedup import SPACES, clean_lines, line_dedup
from pressroom.llm.perfect import PerfectHash

LONG = "this line is long enough to be looked at, "


@pytest.fixture(scope="module")
def docs(spark):
    def make(*rows):
        kinds = "doc_id bigint, text string, row string, doc int, id string, `a.b` string"
        return spark.createDataFrame([(*r, "r", 3, "i", "d") for r in rows], kinds)

    return make


def by_hand(rows, least_chars=40, least_docs=5):
    def key(line):
        k = line.strip(SPACES)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k) if len(k) >= least_chars else None

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        own_id = -(1 << 63) if i is None else i
        left = [x for x in own if not (key(x) and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != own_id)]
        out.append((i, len(own), len(own) - len(left), "\n".join(left)))
    return out


def cleaned(df):
    return [(r.doc["doc_id"], r.n_lines, r.n_dropped, r.kept or "") for r in df.collect()]


ROWS = [
    (1, f"{LONG}one\nshort\n  {LONG}two\t"), (2, f"{LONG.upper()}ONE\n{LONG}two"), (3, f"{LONG}one"), (4, f"x\n{LONG}one\n{LONG}one"),
    (5, f"\r{LONG}one\x0b\n{LONG}one\nend"), (6, None), (7, ""), (8, f"{LONG}Ünder"), (9, f"{LONG}two"), (10, f"{LONG}two\n\n"),
    (None, f"{LONG}two"), (None, f"{LONG}two\nn"), (11, "y" * 39), (12, "é" * 40), (13, "é" * 40), (14, "é" * 40), (15, "é" * 40),
    (16, "é" * 40 + " "), (17, f"{LONG}ünder"),
]


@pytest.mark.parametrize("broadcast_keys", [1 << 20, 0])
@pytest.mark.parametrize("shard_keys", [1 << 15, 1])
def test_hand_made_rows_both_ways(docs, broadcast_keys, shard_keys):
    found = cleaned(clean_lines(docs(*ROWS), broadcast_keys=broadcast_keys, shard_keys=shard_keys))
    assert sorted(found, key=repr) == sorted(by_hand(ROWS), key=repr)


@pytest.mark.parametrize("broadcast_keys", [1 << 20, 0])
def test_repeated_ids_are_one_document(docs, broadcast_keys):
    rows = [(1, f"{LONG}a\nb"), (1, f"{LONG}a\nc"), (2, f"{LONG}a"), (2, f"{LONG}a"), (3, f"{LONG}a"), (4, f"{LONG}a")]
    assert cleaned(clean_lines(docs(*rows), broadcast_keys=broadcast_keys)) == by_hand(rows)
    rows += [(5, f"x\n{LONG}a"), (5, f"x\n{LONG}a")]
    found = cleaned(clean_lines(docs(*rows), broadcast_keys=broadcast_keys))
    assert sorted(found) == sorted(by_hand(rows))
    assert [f[2] for f in sorted(found)] == [1, 1, 1, 1, 1, 1, 0, 0]


@pytest.mark.parametrize("broadcast_keys", [1 << 20, 0])
def test_random_rows_equal_brute_force(docs, broadcast_keys):
    draw = random.Random(5)
    rows = [
        (i, "\n".join(LONG * draw.randint(0, 1) + str(draw.randint(0, 40)) for _ in range(draw.randint(0, 6))))
        for i in draw.sample(range(-50, 400), 200)
    ]
    assert sorted(cleaned(clean_lines(docs(*rows), broadcast_keys=broadcast_keys, shard_keys=4))) == sorted(by_hand(rows))


def test_other_columns_and_nulls_stay(docs):
    df = docs(*[(i, f"{LONG}\nk{i}") for i in range(5)], (9, None))
    out = line_dedup(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect())[0] == (0, "k0", "r", 3, "i", "d")
    assert out.filter("doc_id = 9 and text is null").count() == 1
    assert out.filter("doc_id = 4").first()["text"] == f"{LONG}\nk4"


def test_empty_table_and_no_shared_lines(docs):
    assert clean_lines(docs(*ROWS).limit(0)).count() == 0
    assert cleaned(clean_lines(docs((1, f"{LONG}\n")), broadcast_keys=0)) == [(1, 2, 0, f"{LONG}\n")]


def test_one_very_long_text(docs):
    text = "\n".join(f"{LONG}{k}" for k in range(50_000))
    assert cleaned(clean_lines(docs((1, text), (2, f"{LONG}7"), (3, f"{LONG}7"), (4, f"{LONG}7"), (5, f"{LONG}7"))))[0][1:3] == (50_000, 1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_perfect_hash_numbers_every_key_once(keys):
    first, second = (np.array([k[n] for k in sorted(keys)], np.uint64) for n in (0, 1))
    hashed = PerfectHash.from_bytes(PerfectHash.of(first, second).to_bytes())
    assert sorted(hashed.numbers(first, second)) == list(range(len(keys)))
    outside = hashed.numbers(first + np.uint64(1), second)
    assert ((outside >= -1) & (outside < len(keys))).all()


def test_perfect_hash_parts_keys_that_share_a_word():
    same, other = np.full(1000, 7, np.uint64), np.arange(1000, dtype=np.uint64)
    for first, second in ((same, other), (other, same)):
        assert sorted(PerfectHash.of(first, second).numbers(first, second)) == list(range(1000))
