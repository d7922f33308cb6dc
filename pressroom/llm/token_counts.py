"""Token counts of texts under a unigram vocabulary, with shared prefixes counted once.

A text is cut at white space into pre-tokens, each written with a leading word mark. The tokens of a
pre-token are the pieces of the vocabulary that cover it with the highest total score; of equal
scores the fewest tokens count. A character without a piece is spelled in bytes, one token each.

Pre-tokens are inserted in a trie, level by level. The best score of a prefix depends on the prefix
alone, so it is computed once, when its node is made, for all pre-tokens that begin with it; the node
where a pre-token ends has its count. Counts of pre-tokens met before are kept by each Python worker, up
to ``MAX_KEPT`` of them, and looked up; beginning anew changes nothing but time.

The vocabulary comes from a tokenizer file, whose path is a parameter, and nothing is trained. The file ranks
pieces from frequent to rare; by Zipf's law the score of rank r is ``-ln(r + RANK_SHIFT)``.

Defined results: null and empty texts have no words and no tokens. Pre-tokens of any length are read whole. Repeated
rows have a result each; only ``doc_id`` and ``text`` are looked at.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressroom.llm.bytewords import CHUNK, hash_words, raw_pieces

# The mark before a word and the score of a byte.
MARK = "\u2581".encode()
BYTE_SCORE = -12.0
RANK_SHIFT = 2.7
MAX_KEPT = 1_000_000
# Longer pre-tokens are few and are counted one by one.
DEEPEST = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> dict[bytes, float]:
    """Pieces and scores of a tokenizer file, without its control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    return {sp.id_to_piece(k).encode(): -math.log(rank + RANK_SHIFT) for rank, k in enumerate(plain)}


def _polynomial(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * int(_BASE) + b + 1) % (1 << 64)
    return h


class UnigramCounter:
    """Counts the tokens of pre-tokens, many at a time."""

    def __init__(self, pieces: dict[bytes, float]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=0)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in pieces}):
            of_size = sorted((_polynomial(p), s) for p, s in pieces.items() if len(p) == size)
            self.by_length[size] = (np.array([h for h, _ in of_size], np.uint64), np.array([s for _, s in of_size]))
        self.powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        self.kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def one(self, word: bytes) -> int:
        """The count of a single pre-token, byte by byte."""
        word = MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            score, tokens = best[-1]
            top = (score + BYTE_SCORE, tokens - 1)
            for start in range(max(end - self.longest, 0), end):
                piece = self.pieces.get(word[start:end])
                if piece is not None:
                    top = max(top, (best[start][0] + piece, best[start][1] - 1))
            best.append(top)
        return -best[-1][1]

    def many(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts of pre-tokens of at most ``DEEPEST`` bytes: rows of bytes, filled up with zeros."""
        counts = np.zeros(len(words), np.int64)
        # per level of the trie: parent of each node, hash of its prefix, best score, less its tokens
        parents, hashes = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        scores, less = [np.zeros(1)], [np.zeros(1, np.int64)]
        at, rows = np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(1, len(MARK) + DEEPEST + 1):
            inside = depth - len(MARK)
            if inside > 0:
                done = sizes[rows] < inside
                counts[rows[done]] = -less[-1][at[done]]
                rows, at = rows[~done], at[~done]
            if not len(rows):
                break
            byte = words[rows, inside - 1].astype(np.int64) if inside > 0 else np.full(len(rows), MARK[depth - 1])
            nodes, at = np.unique(at << 8 | byte, return_inverse=True)
            parents.append(nodes >> 8)
            hashes.append(hashes[-1][parents[-1]] * _BASE + (nodes & 255).astype(np.uint64) + np.uint64(1))
            top, tokens = scores[-1][parents[-1]] + BYTE_SCORE, less[-1][parents[-1]] - 1
            up = np.arange(len(nodes))
            for size in range(1, min(depth, self.longest) + 1):
                up = parents[depth - size + 1][up]
                if size not in self.by_length:
                    continue
                keys, values = self.by_length[size]
                tail = hashes[-1] - hashes[depth - size][up] * self.powers[size]
                place = np.minimum(np.searchsorted(keys, tail), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == tail)
                found = scores[depth - size][up[hit]] + values[place[hit]]
                fewer = less[depth - size][up[hit]] - 1
                better = (found > top[hit]) | ((found == top[hit]) & (fewer > tokens[hit]))
                hit = hit[better]
                top[hit], tokens[hit] = found[better], fewer[better]
            scores.append(top)
            less.append(tokens)
        counts[rows] = -less[-1][at]
        return counts

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts kept for the hashes, and which are there."""
        keys, values = self.kept
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return values[at], keys[at] == h

    def keep(self, h: np.ndarray, counts: np.ndarray) -> None:
        if len(self.kept[0]) + len(h) > MAX_KEPT:
            self.kept = h[:0], counts[:0]
        h, counts = np.concatenate([self.kept[0], h]), np.concatenate([self.kept[1], counts])
        order = np.argsort(h, kind="stable")
        self.kept = h[order], counts[order]

    def count(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Begin and count of every pre-token of ``data``."""
        h, starts, ends = hash_words(data)
        each, first, back = np.unique(h, return_index=True, return_inverse=True)
        counts, there = self.known(each)
        new = np.flatnonzero(~there)
        if len(new):
            begin, size = starts[first[new]], (ends - starts)[first[new]]
            short = size <= DEEPEST
            if short.any():
                b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(DEEPEST, np.uint8)])
                reach = np.arange(size[short].max())
                rows = b[begin[short][:, None] + reach]
                counts[new[short]] = self.many(rows, size[short])
            for k in np.flatnonzero(~short):
                counts[new[k]] = self.one(data[begin[k] : begin[k] + size[k]])
            self.keep(each[new], counts[new])
        return starts, counts[back]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each whole text."""
        words, tokens = np.zeros((2, len(texts)), np.int64)
        group, owners, size = [], [], 0

        def counted() -> None:
            begins = np.cumsum([0] + [len(g) + 1 for g in group])
            starts, counts = self.count(b"\n".join(group))
            owner = np.array(owners)[np.searchsorted(begins, starts, side="right") - 1]
            np.add.at(words, owner, 1)
            np.add.at(tokens, owner, counts)

        for k, text in enumerate(texts):
            for part in raw_pieces(text):
                group.append(part)
                owners.append(k)
                size += len(part) + 1
                if size >= CHUNK:
                    counted()
                    group, owners, size = [], [], 0
        if group:
            counted()
        return words, tokens


_counters: dict[int, UnigramCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_chars`` for every row."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(tokenizer or default_file()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(frozenset(pieces.value.items()))
        if key not in _counters:
            _counters.clear()
            _counters[key] = UnigramCounter(pieces.value)
        for part in parts:
            texts = part.column("text").to_pylist()
            words, tokens = _counters[key].texts(texts)
            chars = [len(t or "") for t in texts]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(words), pa.array(tokens), pa.array(chars, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_chars"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_chars bigint")
