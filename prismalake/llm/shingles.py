"""Word and shingle hashes of texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_LOWER[_SPACE] = 0
#: Bytes hashed at once; a longer text is cut between words.
PIECE = 1 << 20
_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    got = _tables.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, PIECE + 1), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _tables[int(base)] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(buf: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LOWER[buf] * _powers(_BASE, len(buf))[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_BACK, len(buf))[start] + mix((end - start).astype(np.uint64)))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order."""
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(buf) <= PIECE:
        return _piece_words(buf)
    cuts, at, spaces = [0], 0, np.flatnonzero(_SPACE[buf])
    while len(buf) - at > PIECE:
        k = np.searchsorted(spaces, at + PIECE)
        if k == len(spaces):
            break
        at = int(spaces[k]) + 1
        cuts.append(at)
    return np.concatenate([_piece_words(buf[a:b]) for a, b in zip(cuts, [*cuts[1:], len(buf)], strict=True)])


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words the whole sequence is one."""
    if not text:
        return np.empty(0, np.uint64)
    w = word_hashes(text)
    k = min(width, len(w))
    if not k:
        return np.empty(0, np.uint64)
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc * _BASE + w[i : len(w) - k + 1 + i])
    return np.unique(acc)
