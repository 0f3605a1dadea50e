"""Dataflow graphs over feature streams: sources make streams, comparators merge them, sinks reduce them to a number.

A stream is one array per node, because a comparator's result at a sample depends on its result one sample before.
Nodes of a level run in parallel; a task holds two streams at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import cut_lineage

# Fixed values. Classes: samples, deviation, sources. Features: generator and modulus of each of the four fields.
CLASSES = {"S": (1_728, 128, 4), "W": (13_824, 256, 8), "A": (110_592, 512, 16)}
FIELDS = ((2, 421), (2, 419), (2, 1427), (5, 3527))
EXPONENT_MODULUS, RANDLC_SEED = 3_141_592, 314_159_265
FAN_IN = 4


def _tree(leaves: int) -> tuple[list[list[int]], int]:
    """Children of each inner node of a tree with ``leaves`` leaves and at most FAN_IN children; ids count level by level."""
    groups, level, following = [], list(range(leaves)), leaves
    while len(level) > FAN_IN:
        parts = [level[k : k + FAN_IN] for k in range(0, len(level), FAN_IN)]
        groups += parts
        level = list(range(following, following + len(parts)))
        following += len(parts)
    return [*groups, level], following + 1


def build_graph(spark: SparkSession, kind: str, sources: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, role) and arcs (tail, head, pos) of a black-hole (BH), white-hole (WH) or shuffle (SH) graph."""
    if kind == "SH":
        depth = sources.bit_length() - 1
        total = sources * (depth + 1)
        arcs = [((k * sources) + (i & ~(1 << k) | b << k), (k + 1) * sources + i, b) for k in range(depth) for i in range(sources) for b in (0, 1)]
    else:
        groups, total = _tree(sources)
        down = [(child, sources + g, pos) for g, members in enumerate(groups) for pos, child in enumerate(members)]
        arcs = down if kind == "BH" else [(total - 1 - head, total - 1 - tail, 0) for tail, head, _ in down]
    tails, heads = {a[0] for a in arcs}, {a[1] for a in arcs}
    role = lambda n: "source" if n not in heads else "sink" if n not in tails else "comparator"
    return spark.createDataFrame([(n, role(n)) for n in range(total)], "node int, role string"), spark.createDataFrame(arcs, "tail int, head int, pos int")


def _int32(x: int) -> int:
    return (x + 2**31) % 2**32 - 2**31


def _signed_mod(x: int, m: int) -> int:
    return x % m if x >= 0 else -(-x % m)


def power_mod(base: int, exponent: int, modulus: int) -> int:
    """base ** exponent with a remainder after every 32-bit product, signs as the products have them."""
    result = 1
    while exponent > 1:
        if exponent % 2:
            result, exponent = _signed_mod(_int32(result * base), modulus), exponent - 1
        else:
            base, exponent = _signed_mod(_int32(base * base), modulus), exponent // 2
    return _signed_mod(_int32(result * base), modulus) if exponent else 1


def stream_length(node: int, samples: int, deviation: int) -> int:
    """Samples in a source's stream: the mean, less the deviation, plus a pseudo-random part of twice the deviation."""
    share = (2 * node + 1) * RANDLC_SEED % 2**46 / 2**46
    return samples - deviation + abs(power_mod(int(1 / share) * ord("S"), 2 * node + 1, 2 * deviation))


def source_stream(node: int, samples: int, deviation: int) -> np.ndarray:
    """Successive modular powers, one sequence for each field, interleaved."""
    n = stream_length(node, samples, deviation)
    start = n * len(FIELDS) * (node + 1) % EXPONENT_MODULUS
    columns = []
    for g, p in FIELDS:
        cycle = [1]
        while (x := cycle[-1] * g % p) != 1:
            cycle.append(x)
        columns.append(np.asarray(cycle, dtype="float64")[(start + 1 + np.arange(n)) % len(cycle)])
    return np.stack(columns, axis=1).ravel()


def resample(a: np.ndarray, n: int) -> np.ndarray:
    """Spreads inner values evenly over their range of the longer stream; the ends keep their values."""
    out, i, k = np.zeros(n), np.arange(1, len(a) - 1), n // len(a)
    low, high = (0.5 * (2 * i - 1) * k).astype(int), (0.5 * (2 * i + 1) * k).astype(int)
    part = a[1:-1] / (high - low + 1)
    for d in range(k + 2):
        on = low + d <= high
        np.add.at(out, low[on] + d, part[on])
    out[0], out[-1] = a[0], a[-1]
    return out


def window_filter(a: np.ndarray, b: np.ndarray, node: int) -> np.ndarray:
    """Each inner sample of a becomes the nearest of three neighbouring samples of b, scaled; ties prefer the middle, then the next."""
    n = max(len(a), len(b))
    a, b = (x if len(x) == n else resample(x, n) for x in (a, b))
    fields, weight = len(FIELDS), (node + 1) / (node + 2)
    a, b = a.reshape(-1, fields).copy(), b.reshape(-1, fields)
    here = ((a - b) ** 2).sum(axis=1)
    scaled, last = weight * b, len(a) - 1
    # The distance at the sample before, for each of the three choices that can have been made there.
    before = np.stack([((np.roll(scaled, -s, axis=0) - b) ** 2).sum(axis=1) for s in (-1, 0, 1)], axis=1).tolist()
    near, choice, chosen = here.tolist(), 0, np.zeros(len(a), dtype=int)
    for i in range(1, last):
        previous = near[0] if i == 1 else before[i - 1][choice + 1]
        choice = 1 if near[i + 1] < near[i] else 0
        if previous < near[i + choice]:
            choice = -1
        chosen[i] = choice
    inner = np.arange(1, last)
    a[inner] = scaled[inner + chosen[inner]]
    return a.ravel()


def evaluate(nodes: DataFrame, arcs: DataFrame, samples: int, deviation: int) -> DataFrame:
    """(node, total): what each sink makes of the streams that reach it. Levels run one after the other."""

    def begin(frames):
        for pdf in frames:
            for n in pdf["node"]:
                yield pd.DataFrame({"node": [n], "stream": [source_stream(int(n), samples, deviation)]})

    def merge(key, pdf):
        node, pdf = int(key[0]), pdf.sort_values("pos")
        out = np.zeros(samples * len(FIELDS))
        for s in pdf["stream"]:
            out = window_filter(out, np.asarray(s, dtype="float64"), node)
        return pd.DataFrame({"node": [node], "stream": [np.trunc(out) // len(pdf)]})

    def reduce(key, pdf):
        node, total = int(key[0]), 0
        for s in pdf["stream"]:
            s = np.asarray(s, dtype="float64")
            total += int((node + 1) * np.add.accumulate(s * s / len(s))[-1])
        return pd.DataFrame({"node": [node], "total": [(node + 1) * (total // len(pdf))]})

    role = nodes.select(F.col("node").alias("head"), "role")
    waiting = arcs.groupBy("head").agg(F.count("*").alias("need"))
    ready = cut_lineage(nodes.filter("role = 'source'").select("node").repartition("node").mapInPandas(begin, "node int, stream array<double>"))
    made = ready
    while True:
        arrived = arcs.join(made.select("node"), F.col("tail") == F.col("node"), "left_semi").groupBy("head").agg(F.count("*").alias("have"))
        due = arrived.join(waiting, "head").filter("have = need").join(role.filter("role = 'comparator'"), "head").join(made.select(F.col("node").alias("head")), "head", "left_anti")
        inputs = arcs.join(due.select("head"), "head", "left_semi").join(made, F.col("tail") == F.col("node"))
        new = cut_lineage(inputs.select("head", "pos", "stream").groupBy("head").applyInPandas(merge, "node int, stream array<double>"))
        if not new.limit(1).count():
            break
        made = made.unionByName(new)
    last = arcs.join(role.filter("role = 'sink'"), "head").join(made, F.col("tail") == F.col("node"))
    return last.select("head", "stream").groupBy("head").applyInPandas(reduce, "node int, total long")


def checksum(spark: SparkSession, kind: str, size: str = "S") -> DataFrame:
    """(total): the sum over the sinks of a graph of a class."""
    samples, deviation, sources = CLASSES[size]
    return evaluate(*build_graph(spark, kind, sources), samples, deviation).agg(F.sum("total").alias("total"))
