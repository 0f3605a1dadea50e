"""Generated inputs. All of them are functions of the index alone, so any number of partitions gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Multiplier and increment of the row generator (modulo 2**32), and of the 64-bit key generator.
LCG_A, LCG_C = 1_664_525, 1_013_904_223
PCG_A = 6_364_136_223_846_793_005
RANDLC_A, RANDLC_SEED = 1_220_703_125, 314_159_265


def random_matrix(spark: SparkSession, rows: int, cols: int, seed: int, modulus: int = 100) -> DataFrame:
    """(r, c, v): row r is a linear congruential sequence that starts from seed + r; v is the state modulo ``modulus``."""
    step = lambda s: (s * LCG_A + LCG_C).bitwiseAND(F.lit(0xFFFFFFFF))
    start = F.array((F.col("id") + seed).bitwiseAND(F.lit(0xFFFFFFFF)))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(cols)), start, lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1)))))
    made = spark.range(rows).select(F.col("id").alias("r"), F.posexplode(F.slice(states, 2, cols)).alias("c", "s"))
    return made.select("r", F.col("c").cast("long").alias("c"), (F.col("s") % modulus).cast("int").alias("v"))


def arithmetic_matrix(spark: SparkSession, rows: int, cols: int, modulus: int = 100) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"), (F.col("id") % modulus).cast("int").alias("v"))


def arithmetic_mask(spark: SparkSession, rows: int, cols: int, percent: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"), (F.col("id") % (100 // percent) == 0).alias("keep"))


def uniform_keys(spark: SparkSession, units: int, keys: int, max_key: int) -> DataFrame:
    """(pe, pos, key): each unit's permuted congruential sequence, bounded by rejection."""

    def make(frames):
        for pdf in frames:
            for pe in pdf["id"]:
                inc, mask = (int(pe) << 1 | 1) & (2**64 - 1), 2**64 - 1
                state = (((inc + int(pe)) & mask) * PCG_A + inc) & mask
                limit, out = (2**32 - max_key) % max_key, []
                while len(out) < keys:
                    old, state = state, (state * PCG_A + inc) & mask
                    x, rot = ((old >> 18 ^ old) >> 27) & 0xFFFFFFFF, old >> 59
                    r = (x >> rot | x << (-rot & 31)) & 0xFFFFFFFF
                    if r >= limit:
                        out.append(r % max_key)
                yield pd.DataFrame({"pe": int(pe), "pos": np.arange(keys), "key": out})

    return spark.range(0, units, 1, units).mapInPandas(make, "pe long, pos long, key long")


def randlc(n: int, seed: int = RANDLC_SEED, a: int = RANDLC_A) -> np.ndarray:
    """The first n values in (0, 1) of the 46-bit multiplicative sequence."""
    out, x = np.empty(n), seed
    for i in range(n):
        x = x * a % 2**46
        out[i] = x / 2**46
    return out


def _neighbours(nodes: DataFrame, nx: int, ny: int, nz: int, points: int) -> DataFrame:
    offsets = [(i, j, k) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1) if points == 27 or abs(i) + abs(j) + abs(k) <= 1]
    shifts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in offsets)))
    spread = nodes.select("row", "x", "y", "z", shifts.alias("o")).select("row", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z"))
    return spread.filter(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1) & F.col("z").between(0, nz - 1))


def box_nodes(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    return spark.range(nx * ny * nz).select(F.col("id").alias("row"), (F.col("id") % nx).alias("x"), F.expr(f"id div {nx} % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))


def stencil_matrix(spark: SparkSession, nx: int, ny: int, nz: int, points: int = 27) -> DataFrame:
    """(row, col, val) of the 27- or 7-point matrix: 27 on the diagonal, -1 beside it; units stack along z."""
    made = _neighbours(box_nodes(spark, nx, ny, nz), nx, ny, nz, points)
    col = F.col("x") + F.col("y") * nx + F.col("z") * nx * ny
    return made.select("row", col.alias("col")).withColumn("val", F.when(F.col("row") == F.col("col"), 27.0).otherwise(-1.0))


def stencil_rhs(matrix: DataFrame) -> DataFrame:
    """(i, v): 27 - (non-zeros of the row - 1), for which the solution is 1 everywhere."""
    return matrix.groupBy("row").agg((F.lit(27.0) - (F.count("*") - 1)).alias("v")).withColumnRenamed("row", "i")


def node_structure(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(row, col): every node of an element mesh with its up to 27 neighbours."""
    return stencil_matrix(spark, nx + 1, ny + 1, nz + 1).select("row", "col")


def block_field(spark: SparkSession, rows: int, cols: int, block: int = 100) -> DataFrame:
    """(r, c, v): 1.0 in the first ``block`` rows and columns, else 0."""
    made = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))
    return made.withColumn("v", F.when((F.col("r") < block) & (F.col("c") < block), 1.0).otherwise(0.0))


def hex_mesh(spark: SparkSession, n: int, length: float = 1.125) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y, z) on [0, length] and elements (elem, corner, node) of n**3 hexahedra, corners counter-clockwise."""
    m = n + 1
    h = length / n
    nodes = spark.range(m**3).select(F.col("id").alias("node"), (F.col("id") % m * h).alias("x"), (F.expr(f"id div {m} % {m}") * h).alias("y"), (F.expr(f"id div {m * m}") * h).alias("z"))
    base = F.col("id") % n + F.expr(f"id div {n} % {n}") * m + F.expr(f"id div {n * n}") * m * m
    corners = [0, 1, m + 1, m, m * m, m * m + 1, m * m + m + 1, m * m + m]
    elems = spark.range(n**3).select(F.col("id").alias("elem"), F.posexplode(F.array(*(base + k for k in corners))).alias("corner", "node"))
    return nodes, elems



# Of 1000, the upper ends of the classes of run lengths, and each class's least length and number of lengths.
RUN_CLASSES = ((773, 1, 15), (937, 16, 16), (970, 32, 32), (974, 64, 64), (978, 128, 128), (981, 256, 256), (1000, 512, 1537))


def material_regions(spark: SparkSession, units: int, elements: int, regions: int, balance: int = 1, seed: int = 0) -> DataFrame:
    """(pe, elem, region): runs of elements of one region, later regions likelier by a power of their number, none twice in a row."""

    def make(frames):
        weights = np.arange(1, regions + 1, dtype=float) ** balance
        for pdf in frames:
            for pe in pdf["id"]:
                g, out, last = np.random.default_rng([seed, int(pe)]), np.empty(0, dtype=int), -1
                while len(out) < elements:
                    free = np.roll(weights, int(pe))
                    if last >= 0 and regions > 1:
                        free[last] = 0
                    last = int(g.choice(regions, p=free / free.sum()))
                    draw = g.integers(1000)
                    low, count = next((a, b) for top, a, b in RUN_CLASSES if draw < top)
                    out = np.concatenate([out, np.full(low + g.integers(count), last + 1)])
                yield pd.DataFrame({"pe": int(pe), "elem": np.arange(elements), "region": out[:elements]})

    return spark.range(0, units, 1, units).mapInPandas(make, "pe long, elem long, region int")
