"""Vectorised hashed text features: words and character n-grams of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Block:
    """Code points of several texts, each between two spaces of its own.

    A gram may hold white space only as its first or last character, so none reaches from one text into another.
    """

    points: np.ndarray
    ends: np.ndarray  # index behind the second space of each text
    space: np.ndarray
    prefix: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Block:
        joined = "".join([f" {t} " for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
        space = (points == 32) | ((points >= 9) & (points <= 13))
        prefix = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(points.astype(np.uint64) * powers(_BASE, len(points)), out=prefix[1:])
        return cls(points, ends, space, prefix, powers(_INVERSE, len(points)))

    def window_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """64-bit hash of the characters in [start, stop), whatever their place."""
        return mix((self.prefix[stop] - self.prefix[start]) * self.back[start])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every word."""
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.space, [True])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        return self.window_hash(start, stop), np.searchsorted(self.ends, start, side="right")

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Character n-grams inside words; the white space beside a word counts as its first or last character."""
        if len(self.points) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inner = np.concatenate(([0], np.cumsum(self.space, dtype=np.int32)))
        start = np.flatnonzero(inner[n - 1 : len(inner) - 1] == inner[1 : len(inner) - n + 1])
        prefix, back = self.prefix, self.back
        h = (prefix[start + n] - prefix[start]) * back[start]
        # All kinds of white space count as one character.
        first, last = self.space[start], self.space[start + n - 1]
        h = np.where(first, h - self.points[start].astype(np.uint64), h)
        tail = self.points[start + n - 1].astype(np.uint64) * np.uint64(pow(int(_BASE), n - 1, 2**64))
        h = np.where(last, h - tail, h)
        return mix(h + np.uint64(n)), np.searchsorted(self.ends, start, side="right")


def repeats(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Text number of every n-word window that occurred earlier in the same text."""
    if len(words) < n:
        return owner[:0]
    h = owner[: len(owner) - n + 1].astype(np.uint64)
    for k in range(n):
        h = mix(h ^ words[k : len(words) - n + 1 + k])
    inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    h, own = h[inside], owner[inside]
    order = np.argsort(h, kind="stable")
    twin = order[1:][h[order][1:] == h[order][:-1]]
    return own[twin]
