"""Vectorised words and shingles: many texts at once as one byte array, no per-word Python objects.

Hashes are 64-bit sums of per-byte random weights times an odd base's powers, finished with
a mixing step, so a word's hash depends on its bytes alone, wherever the word stands.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
WEIGHTS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes that are hashed at once; a longer word is alone.
BLOCK = 1_000_000

#: The ASCII white space that ends a word, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words that are runs of letters and digits; every byte of a non-ASCII letter counts as a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; those of the last size are kept."""
    size = max(BLOCK, -(-n // BLOCK) * BLOCK)
    if size not in _POWERS:
        out = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        if size > BLOCK:
            return tuple(out)
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_texts(texts: list[bytes], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, ``gap`` blanks after each, and where each text starts (one more than texts)."""
    blanks = b" " * gap
    data = LOWER[np.frombuffer(blanks.join(texts) + blanks, np.uint8)]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + gap for t in texts], out=starts[1:])
    return data, starts


def words(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in order: first byte, end, 64-bit hash; and where each text's words start (one more than texts).

    Hashes are made of BLOCK bytes at a time, so that no array of 8 bytes a byte of text is longer.
    """
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(breaks[data], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    hashes, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        low = first[at]
        to = max(at + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        part = data[low : end[to - 1]]
        forward, back = powers(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(WEIGHTS[part] * forward[: len(part)], out=sums[1:])
        hashes[at:to] = mix((sums[end[at:to] - low] - sums[first[at:to] - low]) * back[first[at:to] - low])
        at = to
    return first, end, hashes, np.searchsorted(first, starts)


def batches(texts: list[bytes], most: int = 1_000_000):
    """Index ranges of texts of at most so many bytes together; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text in turn, the sorted distinct hashes of its runs of ``width`` words, and where each text's start.

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    counts = np.diff(bounds)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: max(0, n - k)] += mix(hashes[k:] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    values = mix(rolled[bounds[:-1][owner] + offset])
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.uint64(counts[i])
        for h in hashes[bounds[i] : bounds[i + 1]]:
            value = mix(np.array([value ^ h]))[0] + np.uint64(1)
        values[np.cumsum(made)[i] - 1] = value
    ends = np.cumsum(made)
    for a, b in zip((ends - made).tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(counts)), out=starts[1:])
    return values[keep], starts
