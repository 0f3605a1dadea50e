"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text of a class compresses better
with the dictionary of its class, so the difference of both compressed sizes, normalised by the text's length, is the
evidence, and the only one. A logistic calibration, fitted on labelled texts that the dictionaries haven't seen, makes a
probability of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where zstandard finds the samples too few the samples themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" " * 8


class Difference:
    """The normalised difference of a text's compressed sizes: (bad - good) / (length + ``smooth``), in bytes.

    ``smooth`` keeps the few bytes by which short texts differ at random from counting as much as those of long ones.
    """

    def __init__(self, good: bytes, bad: bytes, level: int, smooth: int):
        self.smooth = smooth
        self.with_ = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def of(self, text: bytes) -> float:
        good, bad = (len(c.compress(text)) for c in self.with_)
        return (bad - good) / (len(text) + self.smooth)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps; the ridge is so small that probabilities stay calibrated."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of at most ``most`` labelled rows of each class (0 and 1), chosen by a hash of the id: text, y, h (the hash).

    Copies of a text count once; one that has both labels counts as good.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(allowed & F.col("doc_id").isNotNull())
    chosen = [known.filter(F.col("y") == y).groupBy("doc_id", "y").agg(F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    got = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 * most ids
    return got.groupBy("text").agg(F.max("y").alias("y"), F.min("h").alias("h"))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", most: int = 1_500, dict_size: int = 65_536, dict_bytes: int = 8_000_000, level: int = 3, smooth: int = 1_000, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1), predicted (1 if score >= cut).

    ``learn``: the rows of ``labels`` that may be learned from, as a condition on doc_id; of those at most ``most`` a
    class are used, a third for the dictionaries and the rest for the calibration. ``dict_bytes``: bytes of text a class
    that the driver gets for its dictionary; of the calibration it gets numbers. Null texts count as empty and get a
    score too; very long texts are compressed whole, one at a time; rows that share an id are scored each for itself;
    null labels are ignored; without any labelled row every score is 0.5.
    """
    known = common.keep(sample(docs, labels, label, most, learn, id_col, text_col), "labelled")
    for_dict = known.filter((F.pmod("h", F.lit(3)) == 0) & (F.col("text") != ""))
    upto = Window.partitionBy("y").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)  # at most ``most`` rows each
    for_dict = for_dict.withColumn("sum", F.sum(F.octet_length("text").cast("long")).over(upto)).filter(F.col("sum") <= dict_bytes)
    got = sorted((r["h"], r["y"], r["text"].encode()) for r in for_dict.select("h", "y", "text").collect())
    good, bad = (dictionary([t for _, y, t in got if y == of], dict_size) for of in (1, 0))

    def differ(batches):
        evidence = Difference(good, bad, level, smooth)
        for batch in batches:
            for ys, some in common.text_slices(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([evidence.of(t) for t in some], pa.float64())], ["y", "d"])

    rest = common.mapped(known.filter(F.pmod("h", F.lit(3)) != 0).select("y", "text"), differ, "y int, d double").collect()
    weights = np.zeros(2)
    if rest:
        x, y = np.array([[1.0, 100 * r["d"]] for r in rest]), np.array([r["y"] for r in rest], float)
        weights = fit_logistic(x, y)
        # The classes' shares in the sample differ from those among all labels: shift the odds back.
        shares = {r["y"]: r["count"] for r in labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(learn).groupBy("y").count().collect()}
        if shares.get(0) and shares.get(1) and 0 < y.mean() < 1:
            weights[0] += np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean()))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad, weights))

    def score(batches):
        good, bad, (constant, slope) = shared.value
        evidence = Difference(good, bad, level, smooth)
        for batch in batches:
            for ids, some in common.text_slices(batch.column(0), batch.column(1)):
                z = constant + slope * 100 * np.array([evidence.of(t) for t in some])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return common.mapped(texts, score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op8_compression_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled ones that aren't held out."""
    scored = quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
