"""64-bit hashes of words and of word shingles, vectorised over the bytes of a whole text."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

# Lower-cases A-Z; every other byte stays.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        n = max(2 * len(_POWERS), n + 1)
        for name, base in (("_POWERS", _MULTIPLIER), ("_INVERSES", _INVERSE)):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def word_spans(text: str | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of a text; byte offsets into its UTF-8 form."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    data = _LOWER[raw] if lower else raw
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_BLANK[raw]
    edges = np.diff(inside)
    return data, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``data``; equal spans have equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased; equal words have equal hashes."""
    return span_hashes(*word_spans(text))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the ``width``-word shingles by position; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    span = min(n, width)
    out = np.zeros(n - span + 1, np.uint64)
    for i in range(span):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : n - span + 1 + i]
    return mix(out + np.uint64(span))
