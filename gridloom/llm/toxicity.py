"""Toxicity by a classifier chain of linear models.

The categories are predicted in the order given. The model of each category sees which words a text has and the
probabilities of all earlier categories; for its training these come from out-of-fold predictions, so it learns how far
they can be trusted on texts that the earlier models haven't seen.

Categories come from the labels. Labels with just one mark are split by word lists: a marked text has a category if it
has one of its words (weak labels), and the mark itself is the last category.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import Words, split_words

_DELETE = string.punctuation.encode()
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Category:
    """``mark``: SQL over the columns of ``labels`` that gives 0 or 1. ``words``: where given, a marked text needs one of them."""

    name: str
    mark: str
    words: tuple[str, ...] = ()


#: General terms of abuse for persons, and of contempt.
INSULTS = ("bastard", "clown", "coward", "cretin", "dimwit", "dumbass", "fool", "freak", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pig", "scum", "scumbag", "simpleton", "twit", "vermin")
CONTEMPT = ("appalling", "contemptible", "despicable", "disgusting", "dumb", "filth", "garbage", "pathetic", "repulsive", "revolting", "rubbish", "sickening", "stupid", "trash", "ugly", "useless", "vile", "worthless")
CATEGORIES = (Category("insult", "toxic", INSULTS), Category("contempt", "toxic", CONTEMPT), Category("toxic", "toxic"))


def word_features(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct words, as buckets."""
    w = Words(texts, delete=_DELETE)
    b = (w.lanes[0] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return [np.unique(b[i:j]) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression on chosen words and dense columns: weights of words, of dense columns, and a constant."""

    def __init__(self, words: np.ndarray, at: np.ndarray, dense: np.ndarray, y: np.ndarray, keep: int, ridge: float = 2e-3, steps: int = 150):
        n, d = len(y), dense.shape[1]
        # Words whose share among the category's texts differs most, in standard errors; rare ones are left out.
        one = np.bincount(words[y[at] == 1], minlength=BUCKETS)
        all_ = np.bincount(words, minlength=BUCKETS)
        share = y.mean()
        z = (one - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1e-9)
        z[all_ < 5] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:keep]
        best = best[np.abs(z[best]) > 4]
        place = np.full(BUCKETS, -1)
        place[best] = np.arange(len(best))
        on = place[words] >= 0
        f, i = place[words[on]], at[on]
        w, v, c = np.zeros(len(best)), np.zeros(d), 0.0
        moment = [np.zeros(len(best)), np.zeros(d), 0.0]
        square = [np.zeros(len(best)), np.zeros(d), 0.0]
        for t in range(1, steps + 1):
            p = _sigmoid(np.bincount(i, weights=w[f], minlength=n) + dense @ v + c)
            r = (p - y) / n
            for k, (g, x) in enumerate(((np.bincount(f, weights=r[i], minlength=len(best)) + ridge / n * w, w), (dense.T @ r, v), (r.sum(), c))):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                step = 0.15 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-9)
                if k == 2:
                    c -= step
                else:
                    x -= step
        self.words, self.dense, self.constant = np.zeros(BUCKETS), v, c
        self.words[best] = w

    def odds(self, words: np.ndarray, at: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=self.words[words], minlength=n) + dense @ self.dense + self.constant


class Chain:
    def __init__(self, models: list[Linear]):
        self.models = models

    @classmethod
    def fit(cls, features: list[np.ndarray], y: np.ndarray, keep: int = 1_000, folds: int = 5) -> Chain:
        """y: a column of 0, 1 for each category, in the order of the chain."""
        n, words = len(features), np.concatenate([np.zeros(0, np.int32), *features])
        at = np.repeat(np.arange(n), [len(f) for f in features])
        fold, dense, models = np.arange(n) % folds, np.zeros((n, 0)), []
        for c in range(y.shape[1]):
            models.append(Linear(words, at, dense, y[:, c], keep))
            if c + 1 < y.shape[1]:
                p = np.zeros(n)
                for k in range(folds):
                    train, test = fold != k, fold == k
                    number = np.cumsum(train) - 1
                    on = train[at]
                    part = Linear(words[on], number[at[on]], dense[train], y[train, c], keep)
                    p[test] = _sigmoid(part.odds(words, at, n, dense)[test])
                dense = np.column_stack([dense, p])
        return cls(models)

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        n, words = len(features), np.concatenate([np.zeros(0, np.int32), *features])
        at, dense, out = np.repeat(np.arange(n), [len(f) for f in features]), np.zeros((n, 0)), []
        for m in self.models:
            out.append(_sigmoid(m.odds(words, at, n, dense)))
            dense = np.column_stack([dense, out[-1]])
        return np.column_stack(out) if out else np.zeros((n, 0))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learns from at most ``most`` rows of ``labels`` that have every mark, chosen by a hash of the id.

    Copies of a text count once. Only the buckets of the chosen texts' distinct words reach the driver, as arrays.
    """
    marks = [f"_y{i}" for i in range(len(categories))]
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(F.expr(c.mark).cast("int").alias(m) for c, m in zip(categories, marks, strict=True))).dropna().dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # ``most`` ids

    def features(batches):
        lists = [{w.encode() for w in c.words} for c in categories]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            f, found = word_features(texts), [set(split_words(t, delete=_DELETE)) for t in texts]
            ys = [[int(bool(y) and (not words or not words.isdisjoint(x))) for y, x in zip(batch.column(2 + i).to_pylist(), found, strict=True)] for i, words in enumerate(lists)]
            cuts = np.cumsum([0, *map(len, f)])
            arrays = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *f])))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays, *(pa.array(y, pa.int32()) for y in ys)], ["doc_id", "words", *marks])

    got = common.mapped(texts.select("doc_id", "text", *marks), features, f"doc_id long, words array<int>, {', '.join(m + ' int' for m in marks)}").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Chain([])
    words = got["words"].combine_chunks()
    flat, cuts = words.flatten().to_numpy(), np.cumsum(np.append(0, words.value_lengths().to_numpy()))
    y = np.stack([got[m].to_numpy() for m in marks], 1).astype(float)
    rows = {(flat[cuts[i] : cuts[i + 1]].tobytes(), y[i].tobytes()): i for i in reversed(range(len(y)))}
    kept = sorted(rows.values())
    return Chain.fit([flat[cuts[i] : cuts[i + 1]] for i in kept], y[kept])


def toxicity_scores(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, cut: float = 0.5, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, p_<category> for each, rejected (the last category's probability is at least ``cut``).

    Null texts count as empty; very long texts are scored whole, one at a time; rows that share an id are scored each for
    itself; of equal hashes the smaller id is learned from first; null marks are left out; without any labelled row
    nothing is rejected (probabilities are 0). An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("_t"))
    names = [f"p_{c.name}" for c in categories]
    return _scored(rows, fit_chain(docs, labels, categories, most, id_col, text_col), names).withColumn("rejected", F.col(names[-1]) >= cut)


def kept(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...] = CATEGORIES, cut: float = 0.5, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``toxicity_scores`` doesn't reject, with all their columns, whatever these are called."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*own).withColumn("_t", common.text_or_empty(own[docs.columns.index(text_col)]))
    names = [f"_p{i}" for i in range(len(categories))]
    scored = _scored(renamed, fit_chain(docs, labels, categories, most, id_col, text_col), names)
    return scored.filter(F.col(names[-1]) < cut).select(*(F.col(c).alias(d) for c, d in zip(own, docs.columns, strict=True)))


def _scored(rows: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """``rows``, whose last column is a text, with the probabilities in its place."""
    shared, schema = rows.sparkSession.sparkContext.broadcast(chain), T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.DoubleType()) for n in names)])

    def score(batches):
        chain = shared.value
        for batch in batches:
            for start, texts in common.text_slices(pa.array(range(batch.num_rows)), batch.column(batch.num_columns - 1)):
                p = chain.probabilities(word_features(texts)) if chain.models else np.zeros((len(texts), len(names)))
                part = batch.slice(start[0], len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(p[:, i]) for i in range(len(names)))], schema.names)

    return common.mapped(rows, score, schema)


def op10_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
