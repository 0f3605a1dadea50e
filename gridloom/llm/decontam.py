"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts and items are word sequences (lower-cased, ASCII punctuation removed). An item of n words is found in a document
that has a range of words within k = min(n div 5, (n - 3) div 3) insertions, deletions and replacements of it. Words are
numbered by the items' vocabulary, so they are compared as words; a word that no item has is one more symbol.

The CGK walk reads a sequence with a pointer that advances or stays by a random bit of the step and the word it stands
on, and puts out the word at each step: edit distance becomes Hamming distance, because after an edit the walks over
both texts soon meet again. The more edits lie behind, the longer that takes, so the walk over an item-sized window is set
anew at every leg of ``LEG`` words: the embedding of an item is that of its legs. A repetition samples a few steps of a
leg's walk; the words there are its key. In a document, walks start at every position where a leg may begin; a key that
an item's leg has too makes the item-sized window around it a candidate. How many repetitions an item's leg gets follows
from the recall asked for and from the agreement measured on random edits (``repeats``).

Two counts lose nothing: a range within k edits of an item has at least n - 2 - 3 k of its runs of three words. Positions
without any run of an item nearby are left out before the walks, windows with too few runs of their item after them.
What is left is verified exactly by a bit-parallel edit distance.

The items are a query set against all rows: they are sent out in blocks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

import string
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import Places, mix, split_words

PUNCTUATION = string.punctuation.encode()
#: Words that a walk reads before it is set anew, and words between the starts of an item's legs.
LEG, STRIDE = 8, 4


def edits(n: int) -> int:
    """Edits allowed for an item of n words; so few that a run of three words is always left."""
    return max(0, min(n // 5, (n - 3) // 3))


def folded(text: bytes) -> list[bytes]:
    """Words without case and ASCII punctuation."""
    return split_words(text if text.isascii() else text.decode().lower().encode(), delete=PUNCTUATION)


def best_range(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the range of ``words`` closest to ``item``; the first end, then the shortest range of those."""

    def scan(pattern: list[int], text: list[int], free: bool) -> tuple[int, int]:
        n = len(pattern)
        full, top = (1 << n) - 1, 1 << (n - 1)
        at = defaultdict(int)
        for i, w in enumerate(pattern):
            at[w] |= 1 << i
        plus, minus, score, best, end = full, 0, n, n, 0
        for j, w in enumerate(text):
            eq = at.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus) & full, plus & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1 | (not free)) & full, mh << 1 & full
            plus, minus = (mh | ~(xv | ph)) & full, ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    pattern, text = item.tolist(), words.tolist()
    distance, end = scan(pattern, text, True)
    _, length = scan(pattern[::-1], text[:end][::-1], False)
    return distance, end - length, end


class Walks:
    """Keys of walks: ``sampled`` steps for each repetition, of the first 3/2 steps for each word of a leg."""

    def __init__(self, repeats: int, leg: int, sampled: int, seed: int = 7):
        rng = np.random.default_rng([seed, leg])
        self.steps = np.sort(rng.integers(0, max(2, leg * 3 // 2), (repeats, sampled)), 1)
        self.bits = rng.integers(1, 2**64, (int(self.steps.max()) + 1, repeats), dtype=np.uint64) | np.uint64(1)
        self.salt = (np.arange(repeats, dtype=np.uint64) + np.uint64(1000 * leg + 1))[:, None]

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(repetition x start) keys of walks from ``starts`` that read word 0 from ``ends`` on. words: numbers."""
        at = np.repeat(starts[None, :], len(self.steps), 0)
        out = np.repeat(mix(self.salt), len(starts), 1)
        padded = np.append(words, 0)
        for j in range(len(self.bits)):
            w = np.where(at < ends, padded[np.minimum(at, len(words))], 0)
            code = mix(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            for s in range(self.steps.shape[1]):
                here = self.steps[:, s] == j
                if here.any():
                    out[here] = mix(out[here] * np.uint64(0x9E3779B97F4A7C15) + code[here])
            at = at + ((code * self.bits[j][:, None]) >> np.uint64(63)).astype(np.int64)
        return out


def leg_of(n: int) -> int:
    return min(n, LEG)


def legs(n: int) -> list[int]:
    """Where the legs of an item of n words start."""
    last = n - leg_of(n)
    return sorted({*range(0, last + 1, STRIDE), last})


def edited(item: np.ndarray, k: int, rng: np.random.Generator, even: bool = False) -> np.ndarray:
    """k insertions, deletions or replacements, at random places or evenly spread. New words are numbers from a million on."""
    places = ((np.arange(k) + rng.random()) * len(item) / max(k, 1)).astype(int) if even else rng.integers(0, len(item), k)
    out: list[int] = item.tolist()
    for at in sorted(places.tolist(), reverse=True):
        kind, new = rng.integers(3), int(rng.integers(1_000_000, 2_000_000))
        at = min(at, max(0, len(out) - 1))
        out[at : at + (kind > 0)] = [] if kind == 2 and len(out) > 1 else [new]
    return np.array(out, np.int64)


@lru_cache(None)
def repeats(n: int, recall: float, sampled: int, trials: int = 400, most: int = 48, margin: int = 2) -> int:
    """Repetitions for items of n words: the fewest by which that share of items at their edit limit became candidates.

    Measured on ``trials`` items, all of different words, between other words; half have their edits at random
    places and half evenly spread, which leaves no leg without one. ``margin`` more are added. From 24 words on an item
    has so many legs that 24 stands for all.
    """
    if n > 24:
        return repeats(24, recall, sampled, trials, most, margin)
    rng, leg, k = np.random.default_rng(n), leg_of(n), edits(n)
    if not k:
        return 1
    walks, first = Walks(most, leg, sampled), np.array(legs(n))
    items = np.arange(1, n * trials + 1).reshape(trials, n)
    texts = [np.concatenate([rng.integers(1_000_000, 2_000_000, 3), edited(x, k, rng, t % 2 > 0), rng.integers(1_000_000, 2_000_000, 2 * leg)]) for t, x in enumerate(items)]
    sizes = np.array([len(t) for t in texts])
    own = walks.keys(items.ravel(), (np.arange(trials)[:, None] * n + first).ravel(), np.repeat(np.arange(1, trials + 1) * n, len(first)))
    got = walks.keys(np.concatenate(texts), np.arange(sizes.sum()), np.repeat(np.cumsum(sizes), sizes))
    # No key of one trial is another's.
    own, trial = own ^ mix(np.repeat(np.arange(trials), len(first)).astype(np.uint64)), np.repeat(np.arange(trials), sizes)
    got = got ^ mix(trial.astype(np.uint64))
    hit = np.stack([np.bincount(trial, weights=np.isin(g, o), minlength=trials) > 0 for g, o in zip(got, own, strict=True)])
    needed = np.where(hit.any(0), hit.argmax(0) + 1, most)
    return min(most, int(np.sort(needed)[int(np.ceil(trials * recall)) - 1]) + margin)


class Items:
    """A block of items with the keys of their legs' walks."""

    def __init__(self, ids: list[int], texts: list[bytes], recall: float, sampled: int):
        places, kept = Places(), []
        places[b""] = 0  # no word has this number
        for i, t in zip(ids, texts, strict=True):
            words = folded(t)
            if len(words) >= 3:
                kept.append((i, np.fromiter(map(places.__getitem__, words), np.int64, len(words))))
        self.number = dict(places)
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        self.by_item = [np.unique(grams(w)) for w in self.words]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.by_item]))
        self.walks, self.tables = {}, {}
        for leg in sorted({leg_of(len(w)) for w in self.words}):
            mine = [x for x, w in enumerate(self.words) if leg_of(len(w)) == leg]
            walks = self.walks[leg] = Walks(max(repeats(n, recall, sampled) for n in {len(self.words[x]) for x in mine}), leg, sampled)
            keys, items, offsets = [], [], []
            for x in mine:
                first = np.array(legs(len(self.words[x])))
                keys.append(walks.keys(self.words[x], first, np.full(len(first), len(self.words[x]))))
                items.append(np.full(len(first), x))
                offsets.append(first)
            keys, items, offsets = np.concatenate(keys, 1), np.concatenate(items), np.concatenate(offsets)
            self.tables[leg] = []
            for row in keys:
                o = np.argsort(row, kind="stable")
                self.tables[leg].append((row[o], items[o], offsets[o]))

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of all items within their edits, the closest range of each pair."""
        if not self.ids:
            return []
        number, parts = self.number, []
        for t in texts:
            words = folded(t)
            parts.append(np.fromiter((number.get(w, 0) for w in words), np.int64, len(words)))
        first = np.cumsum([0, *map(len, parts)])
        words = np.concatenate(parts)
        g = grams(words)
        hit = np.zeros(len(words) + 1, np.int64)
        known = (words[: len(g)] > 0) & (words[1 : len(g) + 1] > 0) & (words[2 : len(g) + 2] > 0) if len(g) else np.zeros(0, bool)
        spots = np.flatnonzero(known)
        spots = spots[_among(g[spots], self.grams)]
        if not len(spots):
            return []
        # Positions with a run behind them that a leg from there could hold.
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(0, spots - LEG - 2), 1)
        np.add.at(near, spots + 1, -1)
        zone = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        owner = np.searchsorted(first, zone, side="right") - 1
        hit = np.unique(np.searchsorted(first, spots, side="right") - 1)
        zone = zone[np.isin(owner, hit)]
        out: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for a in range(0, len(zone), 4_000):
            starts = zone[a : a + 4_000]
            docs = np.searchsorted(first, starts, side="right") - 1
            for leg, walks in self.walks.items():
                for row, (keys, items, offsets) in zip(walks.keys(words, starts, first[docs + 1]), self.tables[leg], strict=True):
                    lo, hi = np.searchsorted(keys, row, "left"), np.searchsorted(keys, row, "right")
                    some = np.flatnonzero(hi > lo)
                    if len(some):
                        n = (hi - lo)[some]
                        i = np.repeat(lo[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        s = np.repeat(some, n)
                        found = np.unique(np.stack([docs[s], items[i], starts[s] - offsets[i]], 1), axis=0)
                        cuts = np.flatnonzero(np.any(found[1:, :2] != found[:-1, :2], 1)) + 1
                        for part in np.split(found, cuts):
                            out[int(part[0, 0]), int(part[0, 1])].append(part[:, 2])
        return [r for (d, x), starts in sorted(out.items()) if (r := self._verified(d, x, np.unique(np.concatenate(starts)), words, g, first))]

    def _verified(self, d: int, x: int, starts: np.ndarray, words: np.ndarray, g: np.ndarray, first: np.ndarray):
        n, best = len(self.words[x]), None
        k = edits(n)
        for lo, hi in _joined(starts.tolist(), k, n + k):
            lo, hi = max(lo, int(first[d])), min(hi, int(first[d + 1]))
            if hi - lo < n - k or _among(g[lo : hi - 2], self.by_item[x]).sum() < n - 2 - 3 * k:
                continue
            distance, a, b = best_range(self.words[x], words[lo:hi])
            if distance <= k and (best is None or distance < best[0]):
                best = (distance, lo + a, lo + b)
        return (d, x, best[0], best[1] - int(first[d]), best[2] - int(first[d])) if best else None


def grams(w: np.ndarray) -> np.ndarray:
    """Codes of the runs of three words."""
    n, w = max(0, len(w) - 2), w.astype(np.uint64)
    return mix(w[:n] + mix(w[1 : n + 1] + mix(w[2 : n + 2])))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def _joined(starts: list[int], before: int, after: int) -> list[list[int]]:
    out: list[list[int]] = []
    for s in starts:
        if out and s - before <= out[-1][1]:
            out[-1][1] = s + after
        else:
            out.append([s - before, s + after])
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = 0.99, sampled: int = 2, block: int = 2_000, block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start_word, end_word, item_words.

    Null or empty texts and items of fewer than three words match nothing; rows that share an id are judged each for
    itself; items with the same text all match; of equally close ranges the first end, then the shortest counts; very long
    texts and items are taken whole; an empty table on either side gives no rows. ``recall``: least share of the ranges
    within the allowed edits that become candidates (see ``repeats``). Items are sent out in blocks of at most ``block``
    items and about ``block_bytes`` of text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    wanted = benchmark.select(F.col(item_id_col).cast("long").alias("id"), common.text_or_empty(item_text_col).alias("t"))
    schema = "doc_id long, item_id long, distance int, start_word int, end_word int, item_words int"

    def search(part):
        shared = docs.sparkSession.sparkContext.broadcast(Items([r["id"] for r in part], [r["t"].encode() for r in part], recall, sampled))

        def run(batches):
            items = shared.value
            for batch in batches:
                for ids, texts in common.text_slices(batch.column(0), batch.column(1)):
                    found = items.find(texts)
                    if found:
                        cols = zip(*((ids[d], items.ids[x], k, a, b, len(items.words[x])) for d, x, k, a, b in found), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 2, *[pa.int32()] * 4], strict=True)], ["doc_id", "item_id", "distance", "start_word", "end_word", "item_words"])

        return common.mapped(rows, run, schema)

    out, part, size = [], [], 0
    for r in wanted.toLocalIterator():
        part.append(r)
        size += len(r["t"])
        if len(part) == block or size >= block_bytes:
            out.append(search(part))
            part, size = [], 0
    if part:
        out.append(search(part))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def op7_cgk_decontam(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
