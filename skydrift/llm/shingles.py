"""Hashed word shingles of many texts at once, in numpy.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A shingle is
five consecutive words; a text of one to four words is one shingle. Everything is 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .decontaminate import FOLD

WORDS = 5
#: Bytes that are hashed at once, and a word more.
PIECE = 1 << 20
U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, U(b), U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and where the words of each text begin (one more at the end)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    buf = np.frombuffer(b" ".join(raw).translate(FOLD) + b" ", np.uint8)
    if not raw:
        return np.zeros(0, U), np.zeros(1, np.int64)
    parts, starts, at = [], [], 0
    while at < len(buf):  # long texts in pieces that end at a blank, as a word's hash doesn't depend on its place
        end = len(buf)
        if end - at > 2 * PIECE:
            blanks = np.flatnonzero(buf[at + PIECE : at + 2 * PIECE] == 32)
            end = at + PIECE + int(blanks[0]) + 1 if len(blanks) else at + PIECE + int((buf[at + PIECE :] == 32).argmax()) + 1
        part = buf[at:end]
        solid = part != 32
        turns = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            turns = np.concatenate([[0], turns])
        a, b = turns[::2], turns[1::2]
        p, q = _power(len(part) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(part.astype(U) * p[: len(part)])])
        parts.append(mix((total[b] - total[a]) * q[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93)))
        starts.append(a + at)
        at = end
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts), edges)


_COEF = [U(pow(0xA0761D6478BD642F, k + 1, 1 << 64)) for k in range(WORDS)]


def shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its shingles in order."""
    h, at = word_hashes(texts)
    n = len(h) - WORDS + 1
    s = np.zeros(0, U)
    if n > 0:
        s = np.zeros(n, U)
        for k in range(WORDS):
            s += h[k : k + n] * _COEF[k]
        s = mix(s)
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= WORDS:
            yield s[a : b - WORDS + 1]
        elif b > a:
            yield mix((h[a:b] * np.array(_COEF[: b - a])).sum(keepdims=True, dtype=U) + U(b - a))
        else:
            yield np.zeros(0, U)


def counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and how often each comes."""
    s = np.sort(s)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.concatenate([first, [len(s)]]))


def elements(s: np.ndarray) -> np.ndarray:
    """A hash for each member of the multiset: the k-th occurrence of a shingle is an element of its own,
    so the overlap of multisets is that of these sets."""
    s = np.sort(s)
    if len(s) < 2 or (s[1:] != s[:-1]).all():
        return s
    first = np.concatenate([[True], s[1:] != s[:-1]])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return np.where(nth == 0, s, mix(s + nth.astype(U) * U(0x9E3779B97F4A7C15)))


PARITY_BITS = 512


def parity(elems: np.ndarray) -> np.ndarray:
    """A bitmap in which each element of a set flips one bit. The symmetric difference of two sets is at least
    the number of bits in which their bitmaps differ (a bitmap filter for set similarity joins)."""
    bits = np.bincount((mix(elems) >> U(55)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)
