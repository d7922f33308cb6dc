"""Language of a text by a convolutional network over its bytes.

A text is cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of widths 2, 3 and 4 slide
over the window, the largest response of each filter goes through a softmax over the languages. The
probabilities of all windows of the whole text are averaged, a last short window by its share.

The network is trained in numpy on windows of at most ``per_language`` labelled documents of each language, those
with the smallest hash of their id, so no language is left out for being rare. A language of few
documents gives more windows of each, and if these are still fewer than those of another language they are repeated:
all languages count the same in training, however many documents they have. Scoring uses the same filters summed up beforehand for every pair of
bytes, which gives the same responses with a few look-ups per byte.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where
no document has a language to learn. Repeated rows have a result each. Only the text enters a
prediction. Only ``doc_id``, ``text`` and, for training, ``lang`` are looked at.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.rows import crc_fold

FOLDS, HELD_OUT = 4, 2
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
PLACES = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
WINDOWS_AT_ONCE = 512
# Windows of a language that training sees, and the least taken of each document.
WINDOWS, EACH = 1500, 3
CHUNK = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    n = max(-(-len(data) // WINDOW), 1)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNet:
    """Embedding, filters and softmax, with their training and a quick way to score."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        self.p["bias"] = np.zeros(len(WIDTHS) * FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["base"] = np.zeros(len(languages))

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of one batch."""
        p, n = self.p, len(x)
        z, at = [], []
        for w in WIDTHS:
            taps = [(p["embed"] @ p[f"f{w}"][t])[x[:, t : t + PLACES]] for t in range(w)]
            response = sum(taps)
            at.append(response.argmax(axis=1))
            z.append(np.take_along_axis(response, at[-1][:, None], axis=1)[:, 0])
        pre = np.concatenate(z, axis=1) + p["bias"]
        top = np.maximum(pre, 0)
        logits = top @ p["out"] + p["base"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"out": top.T @ prob, "base": prob.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        d = (prob @ p["out"].T) * (pre > 0)
        g["bias"] = d.sum(axis=0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            dw = d[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"f{w}"] = np.zeros_like(p[f"f{w}"])
            for t in range(w):
                byte = x[rows, at[k] + t]
                g[f"f{w}"][t] = np.einsum("nfe,nf->ef", p["embed"][byte], dw)
                np.add.at(g["embed"], byte.ravel(), (dw[:, :, None] * p[f"f{w}"][t].T).reshape(-1, EMBED))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> "ByteNet":
        rng, turn = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                turn += 1
                rows = order[lo : lo + batch]
                for k, g in self._step(x[rows], y[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
                    self.p[k] -= rate * (1 - epoch / epochs) * step
        return self

    def tables(self) -> "ByteNet":
        """Responses of pairs of bytes: a filter of four bytes is the sum of two of them."""
        e, p = self.p["embed"], self.p

        def pair(w: int, t: int) -> np.ndarray:
            return ((e @ p[f"f{w}"][t])[:, None] + (e @ p[f"f{w}"][t + 1])[None]).reshape(1 << 16, FILTERS)

        self.heads = np.concatenate([pair(w, 0) for w in WIDTHS], axis=1).astype(np.float32)
        self.third = (e @ p["f3"][2]).astype(np.float32)
        self.tail = pair(4, 2).astype(np.float32)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row per window."""
        out = np.zeros((len(x), len(self.languages)))
        for lo in range(0, len(x), WINDOWS_AT_ONCE):
            b = np.ascontiguousarray(x[lo : lo + WINDOWS_AT_ONCE].T)
            pairs = b[:-1].astype(np.int32) << 8 | b[1:]
            top = np.full((b.shape[1], len(WIDTHS) * FILTERS), -np.inf, np.float32)
            z = np.empty_like(top)
            third, tail = np.empty((2, b.shape[1], FILTERS), np.float32)
            for at in range(PLACES):
                np.take(self.heads, pairs[at], axis=0, out=z, mode="clip")
                np.take(self.third, b[at + 2], axis=0, out=third, mode="clip")
                np.take(self.tail, pairs[at + 2], axis=0, out=tail, mode="clip")
                z[:, FILTERS : 2 * FILTERS] += third
                z[:, 2 * FILTERS :] += tail
                np.maximum(top, z, out=top)
            logits = np.maximum(top + self.p["bias"], 0) @ self.p["out"] + self.p["base"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[lo : lo + WINDOWS_AT_ONCE] = prob / prob.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and mean probability of each whole text."""
        total = np.zeros((len(texts), len(self.languages)))
        waiting, owners, share, size = [], [], [], 0

        def score() -> None:
            nonlocal waiting, owners, share, size
            if waiting:
                prob = self.probabilities(np.concatenate(waiting)) * np.concatenate(share)[:, None]
                np.add.at(total, np.concatenate(owners), prob)
            waiting, owners, share, size = [], [], [], 0

        known = [t is not None and _LETTER.search(t) is not None for t in texts]
        for k, text in enumerate(texts):
            if not known[k] or not self.languages:
                continue
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(data), CHUNK):
                x = windows_of(data[at : at + CHUNK])
                weight = np.ones(len(x))
                weight[-1] = (min(len(data) - at, CHUNK) - (len(x) - 1) * WINDOW) / WINDOW
                waiting.append(x)
                owners.append(np.full(len(x), k))
                share.append(weight)
                size += x.size
                if size >= CHUNK:
                    score()
        score()
        langs, scores = [], []
        for row, ok in zip(total, known, strict=True):
            if not ok or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(row.argmax())
                langs.append(self.languages[best])
                scores.append(float(row[best] / row.sum()))
        return langs, scores


def _some_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``each`` windows of a text, spread over it by a hash of the id."""
    for part in parts:
        ids, langs, out, most = [], [], [], []
        for doc_id, text, lang, each in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "lang", "each")), strict=True):
            x = windows_of((text or "").encode("utf-8", "surrogatepass"))
            n = min(each, len(x))
            for k in range(n):
                ids.append(doc_id)
                langs.append(lang)
                most.append(each)
                out.append(x[(doc_id * 2654435761 % 4294967291 + k * len(x) // n) % len(x)].tobytes())
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(most, pa.int64()), pa.array(out, pa.binary())],
            names=["doc_id", "lang", "each", "x"],
        )


def fit(docs: DataFrame, per_language: int = 500) -> ByteNet:
    """A network trained on a sample of each language of the documents that are not held out."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter("lang is not null and doc_id is not null and text is not null")
    ids = named.filter(crc_fold("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    of_lang = Window.partitionBy("lang")
    sample = (
        ids.withColumn("place", F.row_number().over(of_lang.orderBy(F.xxhash64("doc_id"), "doc_id")))
        .filter(F.col("place") <= per_language)
        .withColumn("each", F.greatest(F.lit(EACH), F.ceil(WINDOWS / F.count("*").over(of_lang))).cast("bigint"))
        .select("doc_id", "lang", "each")
    )
    picked = named.join(F.broadcast(sample), ["doc_id", "lang"]).select("doc_id", "text", "lang", "each")
    picked = picked.mapInArrow(_some_windows, "doc_id bigint, lang string, each bigint, x binary")
    one_each = picked.groupBy("doc_id", "lang", "each").agg(F.array_sort(F.collect_set("x")).alias("x"))
    rows = one_each.select("doc_id", "lang", F.slice("x", F.lit(1), F.col("each").cast("int")).alias("x")).orderBy("doc_id").toArrow()
    langs = [lang for lang, xs in zip(rows.column("lang").to_pylist(), rows.column("x").to_pylist(), strict=True) for _ in xs]
    data = b"".join(x for xs in rows.column("x").to_pylist() for x in xs)
    languages = sorted(set(langs))
    net = ByteNet(languages)
    if len(languages) > 1:
        x = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
        y = np.searchsorted(languages, langs)
        places = [np.flatnonzero(y == k) for k in range(len(languages))]
        # at least as many windows as any language has, so that all count the same
        most = max(map(len, places))
        places = np.concatenate([np.resize(p, most) for p in places])
        net.train(x[places], y[places])
    return net


def predict_languages(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value.tables()
        for part in parts:
            texts = part.column("text").to_pylist()
            langs, scores = net.predict(texts)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
