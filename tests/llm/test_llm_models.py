"""Operators 3, 4, 5, 8, 9 and 10: brute force, round trips and held-out accuracy."""

import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import bytewords, catalog, html_main, licenses, lm, token_counts
from pressroom.llm.quality import Votes, quality_filter, quality_scores, term_counts

SMALL = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t ", "a", "A  b\nc", "x" * 3000, "é ñ\x0b ü", "a b " * 5000, "▁ \U0001f600"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", 1) for k, t in enumerate(ODD)] + [(None, "a b", None, 1), (0, None, "en", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")


def test_words_of_batches_are_words_of_texts():
    texts = [*ODD, "ab cd " * 200_000]
    want = [[w.lower() for w in (t or "").encode().split()] for t in texts]
    names = {}
    seen = 0
    for first, group in bytewords.batches(texts):
        for k, hashes in enumerate(group):
            assert len(hashes) == len(want[first + k])
            for h, w in zip(hashes.tolist(), want[first + k], strict=True):
                assert names.setdefault(h, w) == w
            seen += 1
    assert seen == len(texts) and len(set(names.values())) == len(names)


def test_token_counts_are_those_of_single_words(odd):
    counter = token_counts.UnigramCounter(token_counts.read_pieces(token_counts.default_file()))
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        if row["doc_id"] is None:
            continue
        words = (ODD[row["doc_id"]] or "").encode().split()
        assert row["n_words"] == len(words)
        assert row["n_tokens"] == sum(counter.one(w) for w in words)
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_token_count_finds_the_best_cover():
    counter = token_counts.UnigramCounter({token_counts.MARK: -1.0, token_counts.MARK + b"a": -1.5, b"b": -2.0, b"ab": -2.4, b"c": -1.0})
    assert counter.one(b"ab") == 2  # mark and "ab" cost 3.4, "mark a" and "b" 3.5
    assert counter.one(b"z") == 2
    words = [b"ab", b"abc", b"b", b"abab", b"cab"]
    rows = np.zeros((len(words), 4), np.uint8)
    for k, w in enumerate(words):
        rows[k, : len(w)] = list(w)
    assert counter.many(rows, np.array(list(map(len, words)))).tolist() == [counter.one(w) for w in words]


def test_quality_on_held_out_labels(spark):
    scores = {r["doc_id"]: r for r in catalog.op4_quality(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(scores[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([scores[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.9


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (99, 1), (5, None)], "doc_id bigint, quality int")
    for these in (labels, labels.limit(0)):
        rows = quality_scores(odd, these).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_filter(odd, labels, least=0).columns == odd.columns
    assert quality_filter(odd, labels, least=0).count() == odd.count()
    assert quality_scores(odd.limit(0), labels).count() == 0
    assert term_counts("a b").sum() == 3 and term_counts(None).sum() == 0


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    counts, labels = rng.integers(0, 5, (60, 1024)), rng.integers(0, 2, 60)
    votes = Votes(counts, labels)
    alike = votes.vectors(counts[:5]) @ votes.known.T
    for k, score in enumerate(votes.scores(counts[:5])):
        near = np.argsort(alike[k])[-25:]
        weight = np.maximum(alike[k][near], 1e-3) ** 8
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), rel=1e-4)


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) '</p>'</script></head><body>{body}</body></html>"


def test_main_text_of_a_page():
    blocks = html_main.main_blocks(
        page(
            "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy</div>"
            "<article><h1>Title &amp; more</h1><p><b>one\n two<br>three<p>four &nbsp;five</p>loose <i>text</i>"
            "<div class=\"share-bar\">Share</div><ul><li>a<li>b</ul></article>"
            "<section id='comments'><p>First!</p></section><form>Name</form><footer>&copy; x</footer>"
        ),
        {},
    )
    assert blocks == ["Title & more", "one two three", "four five", "loose text", "a", "b"]
    assert html_main.main_blocks(None, {}) == [] and html_main.main_blocks("plain", {}) == ["plain"]


def test_style_tree_cuts_what_pages_share(spark):
    rows = [
        (k, "http://a.example/x", page(f"<div class=x1>Same for all</div><div class=x2><p>Text {k} of its own</p><p>and {k * 7} more</p></div>"))
        for k in range(40)
    ]
    rows += [(50, None, None), (51, "http://b.example", ""), (52, "http://a.example", "<p>open <b>bold"), (53, "x", page("<article>only</article>"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_main.extract_main(pages).collect()}
    assert all(found[k] == f"Text {k} of its own\nand {k * 7} more" for k in range(40))
    assert (found[50], found[51], found[52], found[53]) == ("", "", "open bold", "only")
    again = {r["page_id"]: r["text"] for r in html_main.extract_main(pages, broadcast_branches=0).collect()}
    assert again == found
    assert html_main.extract_main(pages.limit(0)).count() == 0


def test_language_model_against_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    train = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2]
    counts, total = {}, 0
    for d in train:
        for w in [*d["text"].encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
            total += 1
    rows = {r["doc_id"]: r for r in catalog.op8_language_model(spark, SMALL).collect()}
    assert len(rows) == len(docs)
    base, score, held_tokens = 0.0, 0.0, 0
    for d in docs:
        row, tokens = rows[d["doc_id"]], [*d["text"].encode().lower().split(), None]
        c = np.array([counts.get(w, 0) for w in tokens])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(c), (c > 0).sum(), total)
        assert row["base_score"] == pytest.approx(np.log10((c + 1) / (total + len(counts) + 1)).sum())
        if row["held_out"]:
            base, score, held_tokens = base + row["base_score"], score + row["score"], held_tokens + len(c)
    assert score / held_tokens > base / held_tokens + 0.1


def test_language_model_is_a_distribution_and_its_gradient_holds():
    net = lm.Gru()
    ids = np.arange(lm.LEARNED + lm.SHAPES)
    h = np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    assert np.exp(net.log_probability(np.repeat(h, len(ids), 0), ids)).sum() == pytest.approx(1, abs=1e-3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(3).integers(0, len(ids), (6, 4))
    fresh = np.zeros(x.shape, bool)
    fresh[0] = fresh[3, 1] = True

    def loss():
        h, out = np.zeros((4, lm.HIDDEN)), 0.0
        for t in range(6):
            h = np.where(fresh[t][:, None], 0, h)
            out -= net.log_probability(h, x[t]).sum()
            h = net.forward(h, x[t])[0]
        return out / x.size

    grads, _ = net._window(np.zeros((4, lm.HIDDEN)), fresh, x)
    for name in ("u", "b", "c", "x"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, step = net.p[name][at], 1e-5
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        slope = (up - loss()) / (2 * step)
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx(slope, rel=1e-3)


def test_state_is_carried_through_windows():
    net, x = lm.Gru(), np.random.default_rng(5).integers(0, 1000, 3000)
    h, want = np.zeros((1, lm.HIDDEN), np.float32), 0.0
    for token in x:
        want += net.log_probability(h, np.array([token]))[0]
        h = net.forward(h, np.array([token]))[0]
    assert net.documents([x[:5], x, x[:1]])[1] == pytest.approx(want, rel=1e-4)


def test_tokens_are_put_in_order_by_class_and_looked_up_once():
    token = np.random.default_rng(6).integers(0, lm.LEARNED + lm.SHAPES, 5000)
    order, edges = lm._by_class(lm._classes(token))
    assert lm._classes(token).dtype == np.uint8  # such values are sorted by counting
    for k in range(lm.CLASSES):
        assert (order[edges[k] : edges[k + 1]] == np.flatnonzero(token // lm.CLASS_SIZE == k)).all()
    logits = np.random.default_rng(7).normal(size=(40, 9)).astype(np.float32)
    want = np.exp(logits) / np.exp(logits).sum(axis=0)
    assert lm._softmax(logits) is logits and np.allclose(logits, want, atol=1e-6)
    frequent = np.arange(100, 4000, 7, dtype=np.uint64)
    learned = frequent[::-3]
    model = lm.Model(lm.Gru(), learned, frequent, np.full(len(frequent), 9), 9, 9, np.ones(lm.SHAPES)).prepare()
    assert (np.where(model.id_of < 0, lm.LEARNED + (frequent & np.uint64(7)).astype(int), model.id_of) == model.ids(frequent)).all()


def test_language_model_of_odd_rows(odd):
    rows = lm.likelihoods(odd, odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    assert all(np.isfinite(r["score"]) for r in lm.likelihoods(odd, odd.limit(0)).collect())
    assert lm.likelihoods(odd.limit(0), odd).count() == 0


def test_language_model_scores_stay_with_their_documents(odd):
    """Also where the input is shuffled anew each time it is read."""
    training = odd.limit(3)
    want = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 9)) for r in lm.likelihoods(odd, training).collect()}
    mixed = odd.orderBy(F.rand()).repartition(7)
    assert {(r["doc_id"], r["n_tokens"], round(r["base_score"], 9)) for r in lm.likelihoods(mixed, training).collect()} == want


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [r for r in catalog.op9_language_id(spark, SMALL).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.95


def test_language_of_odd_rows(odd):
    from pressroom.llm.langid import predict_languages

    rows = predict_languages(odd).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in predict_languages(odd.limit(0)).collect()} == set()


def test_licences(spark):
    mit = re.sub(r"(.{60}\S*) ", r"\1\n", ". ".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")) + ".")
    texts = [None, "", f"Intro line\n{mit}", "x | y\nLicensed under CC BY-NC 4.0.\nAll rights reserved. More", "no licence here", "All rights reserved\nAll rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in licenses.license_scan(df).withColumn("names", licenses.licence_names()).collect()}
    assert [found[k]["names"] for k in range(6)] == ["", "", "MIT", "All-rights-reserved,CC-BY-NC-4.0", "", "All-rights-reserved"]
    assert len(found[5]["matches"]) == 2
    span = found[3]["matches"][0]
    assert texts[3][span["start"] : span["stop"]] == "Licensed under CC BY-NC 4.0"
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_entropy_overrules_labels_of_main_text(spark):
    def same(k):
        return f"<div class=x1>Story {k} has {k * 7} words</div>"

    box = "<article><h1>Head {0}</h1><p>Story {0} has {1} words</p><div class=x3>Read our terms</div></article>"
    bodies = {
        "sidebar": lambda k: f"<div class='page has-sidebar'>{same(k)}<div class=sidebar>Links {k}</div></div><footer>End</footer>",
        "article": lambda k: f"<div class='page has-sidebar'><article>{same(k)}</article></div><div class=ad>Buy {k}</div>",
        "form": lambda k: f"<form><nav>Menu</nav>{same(k)}</form>",
        "box": lambda k: box.format(k, k * 7),
        "beside": lambda k: f"<article><p>Story {k}</p></article><div class=x4>has {k * 7} words</div><div class=x5>Terms</div><div class=ad>Buy {k}</div>",
    }
    rows = [(k, f"http://{name}.example", page(body(k))) for name, body in bodies.items() for k in range(30)]
    rows += [(99, f"http://one-{name}.example", page(body(99))) for name, body in bodies.items() if name != "beside"]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {(r["url"].split("/")[2].split(".")[0], r["page_id"]): r["text"] for r in html_main.extract_main(pages).collect()}
    story = "Story {0} has {1} words"
    for k in range(30):
        for name in ("sidebar", "article", "form"):
            assert found[name, k] == story.format(k, k * 7)
        assert found["box", k] == f"Head {k}\n" + story.format(k, k * 7)
        assert found["beside", k] == f"Story {k}\nhas {k * 7} words"
    for name in ("sidebar", "article", "form"):
        assert found["one-" + name, 99] == story.format(99, 693)
    assert found["one-box", 99].startswith("Head 99\nStory 99")
    assert html_main.main_blocks(page("<div class=promo>Only this</div>"), {}) == ["Only this"]


def test_rare_branches_of_a_large_host_are_cut(spark):
    plain = "<div class=x2><p>Text {0} of its own</p></div>"
    promo = "<div class=x1>Same on three pages</div>"
    rows = [(k, "http://a.example/x", (promo if k < 3 else "") + plain.format(k)) for k in range(4000)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, html string").repartition(4)
    for most in (html_main.BROADCAST_BRANCHES, 0):
        found = html_main.extract_main(pages, broadcast_branches=most).collect()
        assert len(found) == 4001 and all(r["text"] == f"Text {r['page_id']} of its own" for r in found)


def test_language_model_learns_from_every_document(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[(start * 7 + k) % 40] for k in range(600)) for start in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (5, None)], "doc_id bigint, text string")
    counts = lm.keep(lm.token_counts(docs))
    assert lm.fit(docs, counts, max_documents=10).trained == counts.agg({"c": "sum"}).first()[0]
    rows = lm.likelihoods(docs, docs, max_documents=0).collect()  # nothing but what all documents teach
    assert sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows) > 0.2


def test_every_licence_rule_on_its_wrapped_notice():
    ready = licenses.Rules(licenses.SENTENCES, licenses.RULES)
    for licence, order in licenses.RULES:
        whole = ". ".join(licenses.SENTENCES[k] for k in order) + "."
        for lead in ("", " * ", "    "):
            text = "x\n\n" + "\n".join(lead + line for line in textwrap.wrap(whole, 70)) + "\n\nmore"
            known, found = ready.matches(text)
            assert (known, [m[0] for m in found]) == (len(order), [licence]), (licence, lead)
    notice = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    (found,) = ready.matches("Intro\n" + notice)[1]
    assert found[0] == "GPL-3.0" and ("Intro\n" + notice)[found[1] : found[2]].endswith("along with this program")
    assert ready.matches(" * " + licenses.SENTENCES["gpl-redistribute"] + ".")[0] == 1
    assert ready.matches("This program is free software: no. You can redistribute it")[0] == 0


def test_rare_language_is_learned(spark):
    from pressroom.llm.langid import fit

    rng = np.random.default_rng(4)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))

    rows = [(k, text("abcdefghij"), "en") for k in range(600)] + [(600 + k, text("абвгдежзик"), "ru") for k in range(5)]
    net = fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 20).tables()
    assert net.languages == ["en", "ru"]
    assert net.predict([text("abcdefghij"), text("абвгдежзик")])[0] == ["en", "ru"]
