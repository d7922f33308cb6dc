"""Operators 1, 2, 6 and 7 on hand-made rows; larger tables are compared with SQL."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pressroom.llm import catalog
from pressroom.llm.components import components
from pressroom.llm.decontaminate import contamination, decontaminate
from pressroom.llm.exact import exact_dedup, exact_groups
from pressroom.llm.mixing import mixed_documents
from pressroom.llm.near import near_dedup, near_groups

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, __row string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with two extra columns whose names operators might use."""

    def make(*texts):
        full = [(t if isinstance(t, tuple) else (n, t)) for n, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 1, 5, "r") for i, t in full], DOCS)

    return make


def words(n, start=0):
    return " ".join(f"w{k}" for k in range(start, start + n))


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_sql_names_are_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()} == set(range(1, 14))


def test_exact_keeps_longest_then_smallest(docs):
    df = docs("a b", "a  b", "ab\n", "x", None, "", " \t", (7, "x"))
    assert got(exact_groups(df), "doc_id", "keep_id", "group_size", "kept") == [
        (0, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True),
        (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 3, 2, False),
    ]
    left = exact_dedup(df)
    assert left.columns == df.columns
    assert got(left, "doc_id", "bucket", "__row") == [(1, 5, "r"), (3, 5, "r"), (6, 5, "r")]


def test_exact_repeated_null_and_no_rows(docs):
    df = docs((1, "a"), (1, "a"), (None, "b"), (None, "c"), (2, "b"))
    assert got(exact_dedup(df), "doc_id", "text") == [(1, "a"), (2, "b"), (None, "c")]
    assert exact_dedup(df.limit(0)).count() == 0
    assert exact_groups(df.limit(0)).count() == 0


def test_groups_of_exact_copies_hold_only_rows_that_may_have_one(docs):
    """Rows alone by length or prefix have a digest and are in no group; the plan groups nothing but the others."""
    df = docs("a b", "ab", "cd", "efg", None, "x" * 300 + "y", "x" * 300 + "z")
    out = exact_groups(df, digest=True)
    assert all(r["full_hash"] is not None for r in out.collect())
    none = exact_groups(df).filter("full_hash is null")
    assert got(none, "doc_id", "keep_id", "group_size", "kept") == [(2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True)]
    assert got(out, "doc_id", "keep_id", "group_size") == [(0, 0, 2), (1, 0, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)]


def test_columns_that_operators_might_use_stay(spark):
    """Columns named like the helper columns, in another case too, and a name with a dot."""
    names = ["_row", "__row", "_key", "__key", "_Bucket", "__bucket", "bucket", "_b", "hot", "rep", "a.b"]
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, words(40)), (4, words(41)), (5, words(20, 500))]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in rows], schema)
    bench = spark.createDataFrame([("i", words(20, 500))], "item_id string, text string")
    full = lambda *ids: sorted((i, t, *[f"{n}{i}" for n in names]) for i, t in dict(rows).items() if i in ids)
    for out, ids in ((exact_dedup(df), (1, 3, 4, 5)), (near_dedup(df.filter("doc_id > 2")), (3, 5)), (decontaminate(df.filter("doc_id > 2"), bench), (3, 4))):
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect())) == full(*ids)


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, words(12)), (2, "Only Three Words"), (3, None), (4, "..."), (None, "no id")], "item_id bigint, text string")
    df = docs(
        f"start {words(12)} end", f"{words(9)} x", "only, three WORDS! only three words", None, "", words(11, 1), "no id", "Only three wörds"
    )
    found = contamination(df, items)
    assert got(found, "doc_id", "n_words", "n_hit", "items") == [
        (0, 14, 12, [1]), (1, 10, 0, None), (2, 6, 6, [2]), (3, 0, 0, None), (4, 0, 0, None), (5, 11, 11, [1]), (6, 2, 2, []), (7, 3, 0, None),
    ]
    assert got(contamination(df, items, broadcast_chars=0), "doc_id", "n_words", "n_hit", "items") == got(
        found, "doc_id", "n_words", "n_hit", "items"
    )
    assert got(decontaminate(df, items), "doc_id") == [(1,), (3,), (4,), (7,)]
    assert decontaminate(df, items).columns == df.columns
    assert decontaminate(df, items.limit(0)).count() == 8
    assert contamination(df.limit(0), items).count() == 0


def test_mix_stays_near_targets(docs):
    rng = random.Random(4)
    rows = [(k, words(rng.randint(1, 200))) for k in range(600)] + [(600, None), (601, "")]
    df = docs(*rows).withColumn("source", F.when(F.col("doc_id") < 20, "a").when(F.col("doc_id") < 300, "b").when(F.col("doc_id") < 500, "c"))
    out = mixed_documents(df).collect()
    assert len(out) == 602
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    total = sum(v[1] for v in by.values())
    assert sum(v[0] for v in by.values()) == pytest.approx(total)
    assert by["a"][0] == 3 * by["a"][1]
    assert by["b"][0] == pytest.approx(2 * by["c"][0])
    for target, _, taken in by.values():
        assert taken == pytest.approx(target, rel=0.05, abs=200)
    assert sorted(map(tuple, mixed_documents(df.repartition(5)).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    assert mixed_documents(df.limit(0)).count() == 0


def brute(rows, percent, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def test_near_groups_of_varied_copies(docs):
    """One text with many varied copies, so that bands are large, and texts of their own."""
    rng = random.Random(9)
    base = words(120).split()
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[at] = f"x{rng.randint(0, 40) if k % 2 else k * 100 + at}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, words(30, 1000 * k)) for k in range(5)] + [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (304, "one three")]
    want = brute(rows, 85, 3)
    assert len({c for _, _, c in want}) > 15
    assert got(near_groups(docs(*rows), 85, 3), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_near_nulls_repeats_and_no_rows(docs):
    df = docs((1, words(40)), (1, words(40)), (2, words(41)), (None, words(40)), (None, None), (3, ""))
    out = got(near_groups(df), "doc_id", "component_id", "kept")
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True)], key=repr)
    left = near_dedup(df)
    assert left.columns == df.columns and left.count() == 5
    assert near_groups(df.limit(0)).count() == 0


def test_near_links_of_every_text_of_an_id(docs):
    """Texts of one id are one document, linked through each of them."""
    a, b, c = words(60), words(60, 500), words(60, 900)
    df = docs((1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, c), (4, c), (0, c + " z"), (6, a), (6, words(9, 2000)), (7, words(9, 2000)))
    ones = {(i, 1) for i in (1, 2, 3, 6, 7)}
    assert set(got(near_groups(df), "doc_id", "component_id")) == ones | {(0, 0), (4, 0)}
    alone = docs((5, a), (5, b), (4, c))
    assert got(near_groups(alone), "doc_id", "component_id") == [(4, 4), (5, 5), (5, 5)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(10, 40)]
    star = [(5, k) for k in range(100, 130)]
    found = got(components(spark.createDataFrame([*chain, *star, (7, 7)], "a bigint, b bigint")), "node", "component")
    assert found == sorted([(k, 10) for k in range(10, 41)] + [(5, 5)] + [(k, 5) for k in range(100, 130)], key=repr)


def test_bands_keep_the_miss_bound_at_every_percent(spark):
    from pressroom.llm import near

    assert near.banding(85) == (24, 6) and near.banding(80) == (29, 5)
    for percent in range(1, 101):
        bands, rows = near.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1 / 80_000 * (1 + 1e-9)
        assert bands * rows <= near.MINIMA or rows == 1
    # pairs at 0.5: of 40, fixed bands of six lost about 69 %
    rows = []
    for k in range(40):
        own = [f"s{k}x{i}" for i in range(40)]
        rows += [(2 * k, " ".join(own[:30])), (2 * k + 1, " ".join(own[10:]))]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=50, width=1)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: d - d % 2 for d, _ in rows}


def test_words_are_cut_by_what_they_hold_and_as_by_what_they_do_not(spark):
    """The same as by the class that is ruled out, for every code point, in less than half of its time."""
    import time

    from pressroom.llm.decontaminate import WORD

    ruled_out = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    points = spark.createDataFrame([("".join(f"a{chr(c)}b " for c in range(k, k + 0x800) if not 0xD800 <= c < 0xE000),) for k in range(0, 0x110000, 0x800)], "t string")
    cut = lambda by: F.regexp_extract_all("t", F.lit(by), F.lit(0))
    assert points.filter(cut(WORD) != cut(ruled_out)).count() == 0
    prose = spark.range(400).coalesce(1).select(F.repeat(F.concat(F.lit("Plain words, and a few MORE of them "), "id"), 500).alias("t"))

    def seconds(by):
        began = time.time()
        prose.agg(F.sum(F.size(cut(by)))).first()
        return time.time() - began

    seconds(WORD)
    assert 2 * min(seconds(WORD) for _ in range(2)) < min(seconds(ruled_out) for _ in range(2))
