"""Log-likelihood of documents by a gated recurrent language model.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of all training documents give the
vocabulary. The ``CLASSES * CLASS_SIZE`` most frequent tokens are learned; the others are known by
their shape (how the word ends, bytes outside ASCII). The softmax is factored: first the class, one of
``CLASSES`` classes of learned tokens or ``SHAPES`` shapes, then the token in its class. Within a shape a
token has the probability (c + 1) / (N + V + 1) of its count c among the N tokens and V words of
that shape, so the counts that the model needs grow with the corpus and every text has a proper
likelihood. The state of a gated recurrent unit is carried through the whole document, window by
window; nothing is cut off.

The unit and its softmax are trained by truncated backpropagation in numpy. They begin with windows drawn
from at most ``max_documents`` training documents, those with the smallest hash of their id. Then they learn from
every token of all training documents: the documents are dealt into ``ROUNDS`` rounds, in each of which
every partition goes on from the same weights, and these are averaged by the tokens learned.

Words are 64-bit hashes (61 bits and a shape): among ten million different words two share one with a
probability of 1 in 40,000. Words with more than 1 in ``SHARE`` of all tokens, fewer than ``SHARE`` of
them, are broadcast; the others are joined by a shuffle in which no word is frequent.

Defined results: null and empty texts have one token, the end. Without training documents every count
is zero. Rows of a null id are not held out. Repeated rows count as often and have a result each. Only ``doc_id``
and ``text`` are looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.bytewords import batches, shaped_words
from pressroom.llm.rows import crc_fold
from pressroom.plans.scratch import keep

FOLDS, HELD_OUT = 7, 2
CLASSES, CLASS_SIZE, SHAPES = 32, 32, 8
LEARNED = CLASSES * CLASS_SIZE
HIDDEN = 16
SHARE = 500_000
END = np.uint64(0xE0D)  # no word: a hash of 61 bits this small is as good as never met
WINDOW, STREAMS, WIDE = 32, 64, 512
ROUNDS, ROUND_RATE = 3, 0.004
TOKENS_AT_ONCE = 2_000_000
COUNTED_AT_ONCE = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: an array of the size of a window costs more to make than to fill."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place, by columns: numpy is slow at sums of many short rows."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _classes(token: np.ndarray) -> np.ndarray:
    """The class or shape of each token, in bytes: numpy sorts these by counting."""
    return np.where(token < LEARNED, token // CLASS_SIZE, token - LEARNED + CLASSES).astype(np.uint8)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in order of class, and where each class of learned ones begins and ends."""
    return np.argsort(group, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(group, minlength=CLASSES)[:CLASSES])))


class Gru:
    """A gated recurrent unit over token ids with a class-factored softmax.

    Ids below ``LEARNED`` are learned tokens, the ``SHAPES`` ids after them the shapes of all others.
    """

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        n, h = LEARNED + SHAPES, HIDDEN
        self.p = {
            "x": rng.normal(0, 0.1, (n, 3 * h)),  # input weights, one row per token
            "u": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
            "b": np.zeros(3 * h),
            "c": rng.normal(0, 0.1, (h, CLASSES + SHAPES)),
            "cb": np.zeros(CLASSES + SHAPES),
            "w": rng.normal(0, 0.1, (CLASSES, h, CLASS_SIZE)),
            "wb": np.zeros((CLASSES, CLASS_SIZE)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def start(self, counts: np.ndarray) -> "Gru":
        """Begin from how often each id occurs."""
        counts = counts + 1.0
        learned = counts[:LEARNED].reshape(CLASSES, CLASS_SIZE)
        self.p["wb"][:] = np.log(learned / learned.sum(axis=1, keepdims=True))
        by_class = np.concatenate([learned.sum(axis=1), counts[LEARNED:]])
        self.p["cb"][:] = np.log(by_class / by_class.sum())
        return self

    def inputs(self) -> np.ndarray:
        """What each token adds to the gates, one row per token."""
        return self.p["x"] + self.p["b"]

    def forward(self, h: np.ndarray, token: np.ndarray, inputs: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The state after a token, and the gates on the way; ``inputs`` are those of the weights as they are."""
        a = (self.inputs() if inputs is None else inputs)[token]
        g = h @ self.p["u"]
        n = HIDDEN
        gates = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        return c + z * (h - c), z, r, c, g[:, 2 * n :]

    def log_probability(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the class, and of the token in it if it is a learned one."""
        group = _classes(token)
        logits = self.p["c"].T @ h.T
        logits += self.p["cb"][:, None]
        out = logits[group, np.arange(len(token))]
        out -= np.log(np.exp(logits, out=logits).sum(axis=0))
        order, edges = _by_class(group)
        states, places = h[order[: edges[-1]]], token[order[: edges[-1]]] % CLASS_SIZE
        more = np.empty(edges[-1], out.dtype)
        for k in range(CLASSES):
            rows = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                inner = self.p["w"][k].T @ states[rows].T
                inner += self.p["wb"][k][:, None]
                more[rows] = inner[places[rows], np.arange(inner.shape[1])]
                more[rows] -= np.log(np.exp(inner, out=inner).sum(axis=0))
        out[order[: edges[-1]]] += more
        return out

    def _window(self, h0: np.ndarray, fresh: np.ndarray, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of one window of all streams, and the state at its end.

        ``fresh`` marks tokens that begin a document: before them the state is zero.
        """
        p, n = self.p, HIDDEN
        steps, streams = x.shape
        before, kept = np.empty((steps, streams, n), h0.dtype), []
        h, inputs = h0, self.inputs()
        for t in range(steps):
            before[t] = h
            before[t][fresh[t]] = 0
            h, *gates = self.forward(before[t], x[t], inputs)
            kept.append(gates)
        flat, token = before.reshape(-1, n), x.ravel()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        scale = np.float32(1 / len(token))
        group = _classes(token)
        d = p["c"].T @ flat.T
        d += p["cb"][:, None]
        _softmax(d)
        d[group, np.arange(len(token))] -= 1
        d *= scale
        g["c"], g["cb"] = (d @ flat).T, d.sum(axis=1)
        dh_out = d.T @ p["c"].T
        order, edges = _by_class(group)
        order = order[: edges[-1]]
        ordered, places = flat[order], token[order] % CLASS_SIZE
        dh_class = np.empty_like(ordered)
        for k in range(CLASSES):
            rows = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                d = p["w"][k].T @ ordered[rows].T
                d += p["wb"][k][:, None]
                _softmax(d)
                d[places[rows], np.arange(d.shape[1])] -= 1
                d *= scale
                g["w"][k], g["wb"][k] = (d @ ordered[rows]).T, d.sum(axis=1)
                dh_class[rows] = (p["w"][k] @ d).T
        dh_out[order] += dh_class
        dh_out = dh_out.reshape(steps, streams, n)
        dh = np.zeros_like(h)
        da, dg = np.empty((2, steps, streams, 3 * n), h.dtype)
        for t in range(steps - 1, -1, -1):
            z, r, c, gc = kept[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before[t] - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            np.concatenate([dz, dr, dc], axis=1, out=da[t])
            np.concatenate([dz, dr, dc * r], axis=1, out=dg[t])
            dh = dh * z + dg[t] @ p["u"].T + dh_out[t]
            dh[fresh[t]] = 0
        da, dg = da.reshape(-1, 3 * n), dg.reshape(-1, 3 * n)
        order = np.argsort(token.astype(np.uint16), kind="stable")
        many = np.bincount(token, minlength=LEARNED + SHAPES)
        ids = np.flatnonzero(many)
        g["x"][ids] = np.add.reduceat(da[order], (np.cumsum(many) - many)[ids], axis=0)
        g["b"] = g["x"].sum(axis=0)
        g["u"] = flat.T @ dg
        return g, h

    def train(self, docs: list[np.ndarray], epochs: int = 3, rate: float = 0.01) -> "Gru":
        """Truncated backpropagation over the documents, joined into ``STREAMS`` streams."""
        if not docs:
            return self
        flat = np.concatenate(docs)
        fresh = np.zeros(len(flat), bool)
        fresh[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        streams = max(1, min(STREAMS, len(flat) // WINDOW))
        steps = len(flat) // streams
        x = flat[: steps * streams].reshape(streams, steps).T
        fresh = fresh[: steps * streams].reshape(streams, steps).T.copy()
        fresh[0] = True
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn, turns = 0, epochs * -(-steps // WINDOW)
        for _ in range(epochs):
            h = np.zeros((streams, HIDDEN), np.float32)
            for lo in range(0, steps, WINDOW):
                turn += 1
                g, h = self._window(h, fresh[lo : lo + WINDOW], x[lo : lo + WINDOW])
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                now = rate * (1 - 0.9 * turn / turns) * min(1.0, 1.0 / max(size, 1e-9))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= now * (m[k] / (1 - 0.9**turn)) / (np.sqrt(s[k] / (1 - 0.99**turn)) + 1e-6)
        return self

    def learn(self, docs: list[np.ndarray], rate: float, state: dict) -> "Gru":
        """One pass over every token of the documents; ``state`` carries the moments from call to call."""
        flat = np.concatenate(docs)
        fresh = np.zeros(len(flat), bool)
        fresh[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        streams = int(min(WIDE, max(1, len(flat) // (16 * WINDOW))))
        steps = -(-len(flat) // streams)
        # filled up with the first tokens once more, so that none is left out
        x = np.resize(flat, steps * streams).reshape(streams, steps).T
        fresh = np.resize(fresh, steps * streams).reshape(streams, steps).T.copy()
        fresh[0] = True
        m = state.setdefault("m", {k: np.zeros_like(v) for k, v in self.p.items()})
        s = state.setdefault("s", {k: np.zeros_like(v) for k, v in self.p.items()})
        h = np.zeros((streams, HIDDEN), np.float32)
        for lo in range(0, steps, WINDOW):
            state["turn"] = turn = state.get("turn", 0) + 1
            g, h = self._window(h, fresh[lo : lo + WINDOW], x[lo : lo + WINDOW])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = np.float32(rate * min(1.0, 1.0 / max(size, 1e-9)))
            for k, v in g.items():
                m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * v
                s[k] = np.float32(0.99) * s[k] + np.float32(0.01) * v * v
                self.p[k] -= now * (m[k] / np.float32(1 - 0.9**turn)) / (np.sqrt(s[k] / np.float32(1 - 0.99**turn)) + np.float32(1e-6))
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unflat(self, values: np.ndarray) -> "Gru":
        at = 0
        for k in sorted(self.p):
            self.p[k] = values[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return self

    def documents(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each whole document; the state runs through all its windows."""
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        flat = np.concatenate([docs[k] for k in order])
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        total = np.zeros(len(docs))
        h, inputs = np.zeros((len(docs), HIDDEN), np.float32), self.inputs()
        at = 0
        while at < lengths[0]:
            active = int(np.searchsorted(-lengths, -at))  # the longest documents come first
            span = int(min(max(40_000 // active, 16), 512, lengths[0] - at))
            here = at + np.arange(span)
            inside = here[:, None] < lengths[None, :active]
            x = flat[np.minimum(begins[None, :active] + here[:, None], len(flat) - 1)]
            h, states = h[:active], np.empty((span, active, HIDDEN), np.float32)
            for t in range(span):
                states[t] = h
                h = self.forward(h, x[t], inputs)[0]
            rows = np.broadcast_to(np.arange(active), (span, active))[inside]
            total += np.bincount(rows, self.log_probability(states[inside], x[inside]), minlength=len(docs))
            at += span
        out = np.empty(len(docs))
        out[order] = total
        return out


@dataclass
class Model:
    """The unit, its tokens, and the counts that scoring needs at hand."""

    gru: Gru
    learned: np.ndarray  # hashes in order of id
    frequent: np.ndarray  # sorted hashes of words with a known count
    counts: np.ndarray  # their counts
    total: int
    words: int
    shape_base: np.ndarray  # N + V + 1 of each shape
    trained: int = 0  # tokens the unit has learned from

    def prepare(self) -> "Model":
        self.by_hash = np.argsort(self.learned)
        self.sorted = self.learned[self.by_hash]
        self.log_counts = np.log10(self.counts + 1.0)
        self.id_of = np.full(len(self.frequent), -1, np.int32)  # -1: not learned
        self.id_of[np.searchsorted(self.frequent, self.learned)] = np.arange(len(self.learned))
        return self

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = LEARNED + (h & np.uint64(7)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, self.by_hash[at], out)
        return out.astype(np.int32)


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, c``: how often each token occurs, summed up within bounds."""
    keys, sums, size = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(keys), return_inverse=True)
        return h, np.bincount(at, np.concatenate(sums)).astype(np.int64)

    for part in parts:
        for _, words in batches(part.column("text").to_pylist(), shaped_words):
            h, c = np.unique(np.concatenate([*words, np.full(len(words), END)]), return_counts=True)
            keys.append(h)
            sums.append(c)
            size += len(h)
            if size > COUNTED_AT_ONCE:
                h, c = summed()
                if len(h) > COUNTED_AT_ONCE // 2:
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])
                    h, c = h[:0], c[:0]
                keys, sums, size = [h], [c], len(h)
    if size:
        h, c = summed()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, c`` over all tokens of all texts."""
    return docs.select("text").mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _some_words(tokens: int):
    """A stretch of words of each text, its place by a hash of the id; the end only if it gets there."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id").to_pylist()
            for first, words in batches(part.column("text").to_pylist(), shaped_words):
                out = []
                for k, h in enumerate(words):
                    h = np.append(h, END)
                    at = ids[first + k] * 2654435761 % 4294967291 % max(len(h) - tokens // 2, 1)
                    out.append(h[at : at + tokens].view(np.int64))
                yield pa.record_batch([part.column("doc_id").slice(first, len(words)), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "hs"])

    return run, "doc_id bigint, hs array<bigint>"


def fit(training: DataFrame, counts: DataFrame, max_documents: int = 1500, tokens: int = 256) -> Model:
    """A model of ``training`` with the stored ``counts`` of its tokens."""
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter(F.col("c") * SHARE > total).orderBy("h").toArrow()
    h = frequent.column("h").to_numpy().astype(np.int64).view(np.uint64)
    c = frequent.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    top = np.lexsort((h, -c))[:LEARNED]
    learned = h[top]
    per_shape = counts.groupBy((F.col("h").bitwiseAND(F.lit(7))).alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    base = np.ones(SHAPES)
    for row in per_shape:
        base[row["s"]] += row["n"] + row["v"]
    np.subtract.at(base, (learned & np.uint64(7)).astype(int), c[top] + 1.0)
    model = Model(Gru(), learned, h, c, int(total), int(words), base).prepare()
    ids = training.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    texts = training.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(*_some_words(tokens))
    some = texts.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().column("hs").to_pylist()
    known = np.zeros(LEARNED + SHAPES)
    known[: len(top)] = c[top]
    known[LEARNED:] = base[:SHAPES] - 1
    model.gru.start(known)
    model.gru.train([model.ids(np.array(x, np.int64).view(np.uint64)) for x in some])
    return learn_all(training, model)


def _learned(shared, rate: float):
    """``n, w``: how many tokens a partition has, and the weights after learning from all of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state, waiting, size, total = shared.value.prepare(), {}, [], 0, 0
        gru = Gru().unflat(model.gru.flat())
        for part in parts:
            for _, words in batches(part.column("text").to_pylist(), shaped_words):
                for h in words:
                    waiting.append(model.ids(np.append(h, END)))
                    size += len(waiting[-1])
                if size >= TOKENS_AT_ONCE:
                    gru.learn(waiting, rate, state)
                    waiting, size, total = [], 0, total + size
        if waiting:
            gru.learn(waiting, rate, state)
        if total + size:
            weights = pa.array([gru.flat().astype(np.float64)], pa.list_(pa.float64()))
            yield pa.record_batch([pa.array([total + size], pa.int64()), weights], names=["n", "w"])

    return run, "n bigint, w array<double>"


def learn_all(training: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``model`` after one pass over all tokens of ``training``."""
    dealt = training.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).alias("round"))
    context = training.sparkSession.sparkContext
    for number in range(rounds):
        shared = context.broadcast(model)
        here = dealt.filter(F.col("round") == number).select("text").mapInArrow(*_learned(shared, ROUND_RATE * (1 - number / rounds)))
        terms = here.select("n", F.posexplode("w").alias("k", "w"))
        means = terms.groupBy("k").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"), F.sum("n").alias("n")).toArrow()
        if len(means):
            order = np.argsort(means.column("k").to_numpy())
            model.gru.unflat(means.column("w").to_numpy()[order])
            model.trained += int(means.column("n")[0].as_py())
    return model


def _score(shared):
    """One row per text: what the model says and the words whose counts are to be looked up."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("all_logs", pa.float64()),
        ("learned_logs", pa.float64()), ("model", pa.float64()), ("hs", pa.list_(pa.int64())),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.prepare()
        log_base = np.log10(model.shape_base)
        learned_logs = np.zeros(LEARNED + SHAPES)
        if len(model.learned):
            learned_logs[: len(model.learned)] = model.log_counts[np.searchsorted(model.frequent, model.learned)]
        waiting: list[tuple] = []
        size = 0

        def scored() -> pa.RecordBatch:
            seqs = [w[-1] for w in waiting]
            logs = model.gru.documents(seqs) / np.log(10)
            tail = np.array([log_base[s[s >= LEARNED] - LEARNED].sum() for s in seqs])
            of_learned = np.array([learned_logs[s].sum() for s in seqs])
            ids, n, seen, all_logs, hs, _ = zip(*waiting, strict=True)
            return pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(all_logs),
                 pa.array(of_learned), pa.array(logs - tail), pa.array(hs, pa.list_(pa.int64()))],
                schema=schema,
            )

        for part in parts:
            ids = part.column("doc_id").to_pylist()
            for first, words in batches(part.column("text").to_pylist(), shaped_words):
                for k, h in enumerate(words):
                    h = np.append(h, END)
                    at = np.minimum(np.searchsorted(model.frequent, h), max(len(model.frequent) - 1, 0))
                    seen = model.frequent[at] == h if len(model.frequent) else np.zeros(len(h), bool)
                    logs = float(model.log_counts[at[seen]].sum()) if seen.any() else 0.0
                    tokens = (LEARNED + (h & np.uint64(7))).astype(np.int32)
                    if seen.any():
                        known = model.id_of[at]
                        tokens = np.where(seen & (known >= 0), known, tokens)
                    waiting.append((ids[first + k], len(h), int(seen.sum()), logs, h[~seen].view(np.int64), tokens))
                    size += len(h)
                if size >= TOKENS_AT_ONCE:
                    yield scored()
                    waiting, size = [], 0
        if waiting:
            yield scored()

    return run, "doc_id bigint, n_tokens bigint, n_frequent bigint, all_logs double, learned_logs double, model double, hs array<bigint>"


def likelihoods(docs: DataFrame, training: DataFrame, max_documents: int = 1500) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``base_score`` is the likelihood by counts alone, both are log10.
    """
    counts = keep(token_counts(training))
    model = fit(training, counts, max_documents)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # rows are numbered in the very table that is stored, so a number means one row, however often tasks are run
    scored = docs.select("doc_id", "text").mapInArrow(*_score(shared))
    found = keep(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = (
        found.select("row", F.explode("hs").alias("h"))
        .join(counts, "h")
        .groupBy("row")
        .agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    )
    n, v = float(model.total), float(model.words)
    all_logs = F.col("all_logs") + F.coalesce("rare_logs", F.lit(0.0))
    return found.drop("hs").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * F.log10(F.lit(n + v + 1.0))).alias("base_score"),
        (F.col("model") + all_logs - F.col("learned_logs")).alias("score"),
    )


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc_fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))
