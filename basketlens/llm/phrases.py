"""Content-defined phrases of sequences, for finding equal windows between documents.

Every window of ``size`` symbols picks its anchor: of the rolling hashes of the k-grams inside it,
the least, leftmost on ties. Consecutive windows with one anchor form a phrase: the windows that
start in [first, last]. Equal windows pick the same anchor at the same place in them, so the phrase
borders depend on content alone, wherever it stands.

The stretch of a phrase is what its windows cover. Equal stretches have pairwise equal windows.
Windows of different stretches can be equal only if their anchors' k-grams are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each k-gram of the uint32 symbols, by doubling; where k is no power of two, of two that overlap."""
    h = (symbols + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    n, factor = 1, 0x01000193
    while n < k:
        step = min(n, k - n)
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        n += step
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    return h ^ (h >> np.uint32(15))


def finer(gram: int, length: int) -> int:
    """The next length of anchors' grams: twice as long, and at last the windows themselves, each then a phrase of its own."""
    return min(2 * gram, length)


def anchors(symbols: np.ndarray, size: int, k: int) -> np.ndarray:
    """For each window of ``size`` symbols, where its anchor is."""
    h = rolling(symbols, k).astype(np.uint64)
    best = (h << np.uint64(32)) + np.arange(h.size, dtype=np.uint64)
    span, n = size - k + 1, 1
    while 2 * n <= span:
        best = np.minimum(best[:-n], best[n:])
        n *= 2
    if n < span:
        best = np.minimum(best[: best.size - (span - n)], best[span - n :])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


#: Symbols that are hashed at once, so that a very long text needs little memory besides itself.
CHUNK = 1 << 18


def phrase_lots(symbols: np.ndarray, size: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """first and last window start, and anchor, of phrases in order, about CHUNK windows at a time; none for a sequence under ``size``."""
    held = np.zeros((3, 0), np.int64)  # the last phrase so far, which may go on
    for lo in range(0, symbols.size - size + 1, CHUNK):
        at = anchors(symbols[lo : lo + CHUNK + size - 1].astype(np.uint32, copy=False), size, k) + lo
        new = np.flatnonzero(at[1:] != at[:-1]) + 1
        found = np.stack([np.concatenate([[0], new]) + lo, np.concatenate([new - 1, [at.size - 1]]) + lo, at[np.concatenate([[0], new])]])
        if held.size and held[2, 0] == found[2, 0]:  # one phrase on both sides of the border
            found[0, 0] = held[0, 0]
            held = held[:, :0]
        found = np.concatenate([held, found], axis=1)
        held = found[:, -1:]
        if found.shape[1] > 1:
            yield found[0, :-1], found[1, :-1], found[2, :-1]
    if held.size:
        yield held[0], held[1], held[2]


def phrases(symbols: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phrase_lots() joined."""
    lots = list(phrase_lots(symbols, size, k)) or [(np.zeros(0, np.int64),) * 3]
    first, last, anchor = (np.concatenate(x) for x in zip(*lots))
    return first, last, anchor


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as disjoint ones in order; those that touch become one."""
    if not starts.size:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[new], e[np.concatenate([new[1:] - 1, [s.size - 1]])]
