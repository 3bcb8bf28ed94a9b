"""Hashes of words in numpy, a batch of whole texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at once; longer texts are cut between words.
AT_ONCE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, AT_ONCE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), AT_ONCE + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 ``raw``, in order; ``lower``: A-Z as a-z."""
    out, n = [], len(raw)
    at = 0
    while at < n:
        end = min(n, at + AT_ONCE)
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        space = _SPACE[piece]
        if end < n and not (space[-1] or _SPACE[raw[end]]):
            cut = np.flatnonzero(space)
            if len(cut):
                end = at + int(cut[-1]) + 1
                piece, space = piece[: end - at], space[: end - at]
            else:  # a word longer than a whole piece: it is hashed alone, in one go
                rest = np.frombuffer(raw, np.uint8, n - at, at)
                stop = np.flatnonzero(_SPACE[rest])
                end = at + (int(stop[0]) if len(stop) else len(rest))
                word = np.frombuffer(raw, np.uint8, end - at, at)
                out.append(mixed(np.array([_long(_LOWER[word] if lower else word)], dtype=np.uint64)))
                at = end
                continue
        if lower:
            piece = _LOWER[piece]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _UP[: len(piece)], dtype=np.uint64, out=sums[1:])
        out.append(mixed((sums[last] - sums[first]) * _DOWN[first]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _long(word: np.ndarray) -> int:
    total, scale = 0, 1
    for at in range(0, len(word), AT_ONCE):
        part = word[at : at + AT_ONCE].astype(np.uint64) + np.uint64(1)
        total = (total + scale * int((part * _UP[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(_BASE, AT_ONCE, 1 << 64) % (1 << 64)
    return total


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct hashes of runs of ``n`` words, sorted; a shorter text is one run; no words, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    runs = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        runs = mixed(runs * np.uint64(_BASE) + words[i : i + len(runs)])
    return np.unique(runs)


def utf8(texts: Iterable[str | None]) -> Iterator[bytes]:
    return ((t or "").encode("utf-8", "surrogatepass") for t in texts)
