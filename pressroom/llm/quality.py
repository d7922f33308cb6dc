"""Document quality by votes of the nearest labelled documents.

Every text is described by its terms: the shapes of its words (length, case, how the word ends,
whether it repeats the word before) and of neighbouring words. Term counts of labelled texts, weighted
by how rare a term is, are reduced to ``RANK`` latent dimensions by a singular value decomposition.
The labelled vectors are broadcast; each text is compared with all of them by cosine, in blocks, and
its nearest ``NEIGHBOURS`` vote with weights that grow with their similarity.

The model is fitted on at most ``max_labelled`` labelled documents, those with the smallest hash of their
id, which bounds what is collected and broadcast whatever the size of the corpus. Texts alone are
looked at: no label, language, source or id enters a score.

Defined results: null and empty texts have no terms and get the mean label of the sample; without any
label every score is 0.5. Labels that are null or belong to no document are left out; of several
labels of one id the mean counts. Repeated rows have a result each. Other columns pass through
``quality_filter`` unchanged.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.bytewords import hash_words, raw_pieces
from pressroom.llm.rows import crc_fold

FOLDS, HELD_OUT = 4, 2
TERMS, SHAPES = 1024, 300
RANK, NEIGHBOURS, SHARPNESS = 32, 25, 8
BLOCK = 256
GOOD = 0.7

_UPPER = np.zeros(256, np.int32)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = 1
# How a word ends: letter, digit, full stop or comma, exclamation or question mark, any other sign.
_END = np.full(256, 4, np.int64)
_END[_LETTER > 0] = 0
_END[ord("0") : ord("9") + 1] = 1
_END[[ord("."), ord(",")]] = 2
_END[[ord("!"), ord("?")]] = 3


def term_counts(text: str | None) -> np.ndarray:
    """How often each of ``TERMS`` terms occurs in the whole text."""
    counts = np.zeros(TERMS, np.int64)
    before, before_hash = -1, None
    for data in raw_pieces(text):
        h, starts, ends = hash_words(data)
        if not len(h):
            continue
        b = np.frombuffer(data, np.uint8)
        upper = np.add.reduceat(_UPPER[b], starts)
        letters = np.add.reduceat(_LETTER[b], starts)
        case = np.where(upper == 0, 0, np.where((upper == letters) & (upper > 1), 2, 1))
        repeat = np.zeros(len(h), np.int64)
        repeat[1:] = h[1:] == h[:-1]
        repeat[0] = before_hash is not None and h[0] == before_hash
        coarse = ((case * 5 + _END[b[ends - 1]]) * 2 + (letters > 0)) * 2 + repeat
        size = np.searchsorted([2, 4, 7, 10], ends - starts, side="right")
        counts += np.bincount(size * 60 + coarse, minlength=TERMS)
        last = np.concatenate(([before], coarse[:-1]))
        pair = (last * 61 + coarse)[last >= 0]
        counts += np.bincount(SHAPES + pair * 2654435761 % (1 << 32) % (TERMS - SHAPES), minlength=TERMS)
        before, before_hash = int(coarse[-1]), h[-1]
    return counts


class Votes:
    """Labelled vectors and what is needed to compare a text with them."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.rarity = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.25)
        weighted = self._weighted(counts)
        values, vectors = np.linalg.eigh(weighted.T @ weighted)
        self.axes = np.ascontiguousarray(vectors[:, np.argsort(values)[::-1][:RANK]], np.float32)
        self.known = self.vectors(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts, dtype=np.float32) * self.rarity
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-12)))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = self._weighted(counts) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.mean)
        filled = np.flatnonzero(counts.sum(axis=1))
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(filled), BLOCK):
            rows = filled[lo : lo + BLOCK]
            alike = self.vectors(counts[rows]) @ self.known.T
            near = np.argpartition(alike, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(alike, near, axis=1), 1e-3) ** SHARPNESS
            out[rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def _count_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        counts = [term_counts(t).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
        yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.binary())], names=["doc_id", "counts"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> Votes:
    """Votes of a sample of the labelled documents that are not held out."""
    sample = (
        labels.filter("quality is not null and doc_id is not null")
        .filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    counted = texts.mapInArrow(_count_rows, "doc_id bigint, counts binary").dropDuplicates(["doc_id"])
    rows = counted.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("counts", "quality").toArrow()
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32).reshape(-1, TERMS)
    return Votes(counts, np.array(rows.column("quality").to_pylist(), float))


def _batch_scores(votes: Votes, part: pa.RecordBatch) -> np.ndarray:
    texts = part.column("text").to_pylist()
    found = [
        votes.scores(np.array([term_counts(t) for t in texts[lo : lo + BLOCK]])) for lo in range(0, len(texts), BLOCK)
    ]
    return np.concatenate(found) if found else np.zeros(0)


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """``doc_id, score`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.record_batch([part.column("doc_id"), pa.array(_batch_scores(model.value, part))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, least: float = GOOD, max_labelled: int = 6000) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(_batch_scores(model.value, part) >= least))

    return docs.mapInArrow(run, docs.schema)
