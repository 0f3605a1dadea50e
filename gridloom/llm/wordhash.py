"""Hashes of words and of word shingles, for many documents at once.

A word's hash is the 128-bit xxh3 of its bytes, in two lanes of 64 bits; words that differ are told apart by their bytes
before they are hashed, once for each distinct word. A shingle's lanes are sums of its words' lanes times a fixed odd
factor for each place, mixed.
"""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Places(dict):
    """Words' numbers in the order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def split_words(doc: bytes, lower: bool = True, delete: bytes = b"") -> list[bytes]:
    """Words between ASCII white space; A to Z lower-cased; the bytes of ``delete`` are taken out before."""
    if delete:
        doc = doc.translate(None, delete)
    return (doc.lower() if lower else doc).split()


class Words:
    """Word hashes of several documents: lanes 0 and 1. ``first[j]`` to ``first[j + 1]`` are document j's words."""

    def __init__(self, docs: list[bytes], lower: bool = True, delete: bytes = b""):
        places, parts, first = Places(), [], [0]
        for d in docs:
            words = split_words(d, lower, delete)
            parts.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            first.append(first[-1] + len(words))
        self.first = np.array(first, np.int64)
        at = np.concatenate([np.zeros(0, np.int32), *parts])
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, places)), "<u8").reshape(-1, 2)
        self.lanes = tuple(np.ascontiguousarray(digests[:, k])[at] for k in (0, 1))

    @property
    def hashes(self) -> np.ndarray:
        return self.lanes[0]

    def shingles(self, k: int, lane: int = 0) -> list[np.ndarray]:
        """Each document's hashes of its runs of k words, in order; of the whole sequence if it has fewer words."""
        w, factor = self.lanes[lane], _FACTORS[lane]
        n = max(0, len(w) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += w[i : i + n] * np.uint64(pow(factor, i + 1, 2**64))
        h = mix(h)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(h[a : b - k + 1])
            elif b > a:
                x = np.zeros(1, np.uint64)
                for i in range(a, b):
                    x += w[i : i + 1] * np.uint64(pow(factor, i - a + 1, 2**64))
                out.append(mix(x + np.uint64(b - a)))
            else:
                out.append(h[:0])
        return out


def shingle_sets(docs: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's set of shingles: both lanes, in the order of the first."""
    words, out = Words(docs), []
    for a, b in zip(words.shingles(k), words.shingles(k, 1), strict=True):
        o = np.argsort(a)
        a, b = a[o], b[o]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        out.append((a[new], b[new]))
    return out


def common_shingles(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Shingles that both sets have, equal in both lanes."""
    at = np.minimum(np.searchsorted(y[0], x[0]), max(0, len(y[0]) - 1))
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum()) if len(y[0]) else 0
