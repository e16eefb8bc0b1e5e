"""Anchors: sampled k-grams that equal windows share, in numpy.

Every window of ``window`` units (bytes or words) has one anchor, the k-gram in it
with the smallest hash (leftmost on ties); equal windows have the same anchor.  The
windows of a text fall into runs with a common anchor occurrence, so a repeated
window can be found by comparing only the runs of equal anchors.
"""

from __future__ import annotations

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)  # odd constants of a multiplicative hash
_B = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
BLOCK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> _S)) * _B
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def kgrams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on; the last k - 1 places have none."""
    n = max(0, len(units) - k + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):  # short arrays stay in the processor's cache
        out[a:a + BLOCK] = _kgrams(units[a:a + BLOCK + k - 1], k)
    return out


def _kgrams(units: np.ndarray, k: int) -> np.ndarray:
    have, out, level = 0, None, units.astype(np.uint64)
    size, factor = 1, _A
    # Joins of doubling lengths: h[a + b](i) = h[a](i) * f^b + h[b](i + a).
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, have = level, size
                else:
                    n = min(len(out), len(level) - have)
                    out = out[:n] * factor + level[have:have + n]
                    have += size
            if size * 2 > k:
                break
            n = len(level) - size
            if n <= 0:
                return np.zeros(0, np.uint64)
            level = level[:n] * factor + level[size:]
            factor = factor * factor
            size *= 2
        return mix(out[:max(0, len(units) - k + 1)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each stretch of w values."""
    size, level = 1, x
    while size * 2 <= w:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = w - size
    return level if not rest else np.minimum(level[:-rest], level[rest:])


def runs(hashes: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, anchor hash) of runs of window starts with one anchor occurrence.

    ``hashes`` are the k-gram hashes of concatenated texts and ``ends`` the end of each
    text; windows never go over the end of a text.
    """
    w = window - k + 1
    n = len(hashes) - w + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    least = sliding_min(hashes, w)
    # Leftmost place of the least value: the next place from the window's start on that
    # holds a value equal to its window's minimum is found through changes of the minimum.
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    # A window whose minimum equals the one before may still have another occurrence of it
    # as its leftmost: when the value at the window start before was itself the minimum.
    change[1:] |= hashes[:n - 1] == least[:-1]
    valid = np.zeros(n + 1, bool)
    starts = np.concatenate([[0], ends[:-1]])
    lasts = ends - window + 1  # one past the last window start
    good = lasts > starts
    edge = np.zeros(n + window + 1, np.int32)
    np.add.at(edge, starts[good], 1)
    np.add.at(edge, lasts[good], -1)
    valid = np.cumsum(edge)[:n] > 0
    change[starts[good & (starts < n)]] = True
    begin = np.flatnonzero(change & valid)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    # A run ends where the next begins or where the windows of its text do.
    stop = np.concatenate([begin[1:], [n]])
    text = np.searchsorted(ends, begin, side="right")
    stop = np.minimum(stop, lasts[text])
    return begin, stop, least[begin]
