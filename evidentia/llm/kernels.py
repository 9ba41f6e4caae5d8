"""Vectorised text kernels over batches of UTF-8 text (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER_CODE = BYTE_CODE[LOWER]
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts of about STEP_BYTES together."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        if size and size + len(text) > STEP_BYTES:
            yield a, b
            a, size = b, 0
        size += len(text) + 1
    if a < len(texts):
        yield a, len(texts)


def words(texts: list[bytes], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of the texts, in order, and where each text's words begin.

    Words are runs of bytes outside ``separators`` with A-Z lowered; the second array has one more
    entry than there are texts.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = np.concatenate(([False], ~separators[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), dtype=U64)
    a = 0
    while a < len(starts):  # words of about STEP_BYTES at a time, as their hashes don't depend on their place
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP_BYTES, "right")))
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        up, down = powers(int(e[-1]))
        total = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(LOWER_CODE[buf[starts[a] : ends[b - 1]]] * up, dtype=U64)))
        hashes[a:b] = (total[e] - total[s]) * down[s]
        a = b
    hashes = mix(hashes + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    q, n = U64(0xA0761D6478BD642F), len(hashes)
    rolled = np.zeros(max(0, n - width + 1), dtype=U64)
    for k in range(width):
        rolled = rolled * q + hashes[k : k + len(rolled)]
    rolled = mix(rolled + U64(width))
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * q + h
                yield mix(np.array([whole + U64(b - a)], dtype=U64))
        else:
            yield np.zeros(0, dtype=U64)
