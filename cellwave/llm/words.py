"""Hashes of the words and shingles of many texts at once, on byte arrays."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_KEYS = np.array([0xD6E8FEB86659FD93, 0xA5A3564E4D2F1B97, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def powers(base: int, count: int) -> np.ndarray:
    """``base ** k mod 2**64`` for k from 0 to ``count`` - 1."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        step = np.full(max(count, 1 << 20), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and where each text's words begin and the last end.

    ``data`` and ``at`` come from ``text_bytes``; words lie between white space or the ends of their text.
    """
    n = len(data)
    low = LOWER[data]
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    close = inside.copy()
    close[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mixed(raw), np.searchsorted(starts, at)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of fewer words, the hash of all of them."""
    if not len(words):
        return words
    if len(words) < size:
        return mixed((words * _KEYS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = words[: len(words) - size + 1] * _KEYS[0]
    for k in range(1, size):
        total = total + words[k : len(words) - size + 1 + k] * _KEYS[k]
    return mixed(total)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    words, cuts = word_hashes(data, at)
    return [np.unique(shingles(words[a:b], size)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
