"""Words of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. Texts are taken in chunks of bounded size, long texts in pieces cut at
white space, so memory does not grow with the text.
"""

from collections.abc import Callable, Iterator

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 19
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_ENDS = np.full(256, 3, np.uint8)
_ENDS[ord("a") : ord("z") + 1] = _ENDS[128:] = 0
_ENDS[[ord("."), ord(",")]] = 1
_ENDS[[ord("!"), ord("?")]] = 2
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``data``."""
    b = np.frombuffer(data, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _IS_SPACE[b]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _powers_to(len(b))
    terms = (b.astype(np.uint64) + np.uint64(1)) * up[: len(b)]
    terms[gap[1:-1]] = 0
    sums = np.add.reduceat(terms, starts) * down[starts]
    return mix(sums ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE))), starts, ends


def shaped_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words``, with the shape of the word in the lowest three bits of the hash.

    The shape says whether the word ends in a letter, a full stop or comma, a mark, or another sign,
    and whether it has bytes outside ASCII.
    """
    h, starts, ends = hash_words(data)
    if not len(h):
        return h, starts, ends
    b = np.frombuffer(data, np.uint8)
    wide = np.bitwise_or.reduceat(b, starts) >> 7
    return h & ~np.uint64(7) | (_ENDS[b[ends - 1]] << 1 | wide).astype(np.uint64), starts, ends


def raw_pieces(text: str | None) -> Iterator[bytes]:
    """The bytes of a text in parts of about ``CHUNK`` bytes, cut at white space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(c, at, at + CHUNK) for c in (b" ", b"\n"))
        if cut <= at:
            later = [k for k in (data.find(bytes([c]), at + CHUNK) for c in SPACES) if k >= 0]
            if not later:
                break
            cut = min(later)
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_of(text: str | None, hashed: Callable = hash_words) -> np.ndarray:
    """The hashes of all words of one text."""
    return np.concatenate([hashed(p.lower())[0] for p in raw_pieces(text)])


def batches(texts: list[str | None], hashed: Callable = hash_words) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``first, word hashes of texts[first], texts[first + 1], ...`` in groups of bounded size."""
    first, group, size = 0, [], 0

    def split() -> list[np.ndarray]:
        h, starts, _ = hashed(b"\n".join(group))
        begins = np.cumsum([0] + [len(g) + 1 for g in group])
        return np.split(h, np.searchsorted(starts, begins[1:-1]))

    for k, text in enumerate(texts):
        if text is not None and len(text) > CHUNK // 4:
            if group:
                yield first, split()
            yield k, [words_of(text, hashed)]
            first, group, size = k + 1, [], 0
            continue
        group.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1]) + 1
        if size >= CHUNK:
            yield first, split()
            first, group, size = k + 1, [], 0
    if group:
        yield first, split()
