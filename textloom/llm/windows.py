"""Vectorised hashing of fixed windows over a run of symbols.

Symbols are unsigned 64-bit values (a table value for a byte, a strong hash for a word).  Windows are hashed
by a doubling ladder with a non-linear mix at each step, so that a window costs a few numpy passes whatever
its length.  `anchors` gives each window the smallest hash of the grams inside it: equal windows always have
equal anchors, so work on windows can be dealt out by anchor.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> _S32)
    x *= _B
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces."""
    x = left * _A
    x += right
    x ^= x >> _S32
    x *= _B
    x ^= x >> _S29
    return x


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` symbols; one value for each start, none where fewer symbols are left."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, out = symbols, 1, 0, None
    while True:
        if length & size:
            piece = level[done : done + n]
            out = mix(piece.copy()) if out is None else pair(out, piece)
            done += size
        if done == length:
            return mix(out)
        level = pair(level[:-size], level[size:])
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    return np.minimum(level[:n], level[width - size : width - size + n])


def rolling(symbols: np.ndarray, length: int) -> np.ndarray:
    """Polynomial value of each run of `length` symbols, scrambled.  Cheaper than `gram_hashes` and good enough
    to choose anchors, where a collision costs time and never a wrong result."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, done, out, power = symbols, 1, 0, None, int(_A)
    while True:
        factor = np.uint64(power)
        if length & size:
            piece = level[done : done + n]
            if out is None:
                out = piece.copy()
            else:
                out *= factor
                out += piece
            done += size
        if done == length:
            out ^= out >> _S32
            out *= _B
            out ^= out >> _S29
            return out
        following = level[:-size] * factor
        following += level[size:]
        level, size, power = following, size * 2, power * power % 2**64


def anchors(symbols: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window start the smallest gram hash inside the window."""
    return sliding_min(rolling(symbols, gram), window - gram + 1)


def anchor_places(grams: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places of the grams that are the smallest of some window around them."""
    width = len(grams) - len(anchor) + 1
    edge = np.zeros(width - 1, np.uint64)
    largest = ~sliding_min(~np.concatenate([edge, anchor, edge]), width)
    return np.flatnonzero(largest == grams)


def several_places(grams: np.ndarray, places: np.ndarray, anchor: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run whether its anchor stands at two places or more that the run's windows cover."""
    width, size = len(grams) - len(anchor) + 1, len(grams) + 1
    values, number = np.unique(grams[places], return_inverse=True)
    keys = np.sort(number.astype(np.int64) * size + places)
    own = np.searchsorted(values, anchor[starts]).astype(np.int64) * size
    return np.searchsorted(keys, own + starts + lengths + width - 1) - np.searchsorted(keys, own + starts) > 1


def runs(anchor: np.ndarray, valid: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of neighbouring valid windows that have one anchor, cut at `longest`."""
    n = len(anchor)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    lengths = np.diff(np.append(starts, n))
    keep = valid[starts]
    starts, lengths = starts[keep], lengths[keep]
    if len(lengths) and lengths.max() > longest:
        pieces = -(-lengths // longest)
        first = np.repeat(starts, pieces)
        step = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + lengths, pieces)
        starts = first + step * longest
        lengths = np.minimum(longest, ends - starts)
    return starts, lengths
