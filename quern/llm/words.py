"""Words and word shingles of a block's documents as 64-bit hashes, straight from the bytes."""

from __future__ import annotations

import numpy as np

from quern.llm.blocks import LOWER_CODE, U64, PrefixHash, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20
_K = mix(np.arange(11, 11 + 64, dtype=U64)) | U64(1)
_SHORT = U64(0xA24BAED4963EE407)


def word_spans(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that aren't ``space``), and where each document's words begin among them."""
    letter = ~space[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:n]
    end = letter.copy()
    end[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = LOWER_CODE) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo = starts[i]
        ph = PrefixHash(data[lo : ends[j - 1]], code)
        size = ends[i:j] - starts[i:j]
        out[i:j] = mix(ph.of(starts[i:j] - lo, size) + size.astype(U64))
        i = j
    return out


def shingles(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each document's shingles begin, and the shingles: sorted distinct hashes of its ``k``-word runs (of the whole text if shorter)."""
    starts, ends, woff = word_spans(offsets, data)
    wh = word_hashes(data, starts, ends)
    m = np.diff(woff)
    n = np.where(m >= k, m - k + 1, np.minimum(m, 1))
    soff = np.concatenate([[0], np.cumsum(n)])
    s = np.empty(soff[-1], U64)
    if len(wh) >= k:
        full = wh[: len(wh) - k + 1] * _K[0]
        for j in range(1, k):
            full += wh[j : len(wh) - k + 1 + j] * _K[j]
    long = np.flatnonzero(m >= k)
    if len(long):
        count = n[long]
        at = np.repeat(woff[long] - soff[long], count) + _ranges(soff[long], count)
        s[_ranges(soff[long], count)] = mix(full[at])
    for d in np.flatnonzero((m > 0) & (m < k)):
        w = wh[woff[d] : woff[d + 1]]
        s[soff[d]] = mix((w * _K[: len(w)]).sum(dtype=U64, keepdims=True) + _SHORT * np.full(1, len(w), U64))[0]
    for d in np.flatnonzero(n > 1):
        s[soff[d] : soff[d + 1]].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[soff[:-1][n > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return total[soff], s[new]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+count[0]-1, start[1] .. , one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(count.sum())
