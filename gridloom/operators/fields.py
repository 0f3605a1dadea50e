"""Fourier transforms of cubes, finite elements, multigrid cycles and element-wise hydrodynamics."""

from __future__ import annotations

from math import pi
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clamp
from ..model import cut_lineage
from .stencil import neighbour_sum, prolong, restrict, smooth, star

CUBE = "z long, y long, x long, re double, im double"


def fft3(cube: DataFrame, inverse: bool = False) -> DataFrame:
    """Transform of (z, y, x, re, im) along each axis; a pencil is one group, so a task holds single lines."""

    def along(axis: str):
        def line(pdf):
            pdf = pdf.sort_values(axis)
            values = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            out = np.fft.ifft(values) if inverse else np.fft.fft(values)
            return pdf.assign(re=out.real, im=out.imag)[["z", "y", "x", "re", "im"]]

        return line

    for axis in ("x", "y", "z"):
        cube = cube.groupBy(*(a for a in "zyx" if a != axis)).applyInPandas(along(axis), CUBE)
    return cube


def strided_checksum(cube: DataFrame, nx: int, ny: int, nz: int, terms: int = 1024) -> DataFrame:
    """Sum of the elements (5 j mod nz, 3 j mod ny, j mod nx) for j = 1 to terms, over the number of elements."""
    j = cube.sparkSession.range(1, terms + 1)
    at = j.select((F.col("id") * 5 % nz).alias("z"), (F.col("id") * 3 % ny).alias("y"), (F.col("id") % nx).alias("x"))
    return cube.join(at, ["z", "y", "x"]).agg((F.sum("re") / (nx * ny * nz)).alias("re"), (F.sum("im") / (nx * ny * nz)).alias("im"))


def hex_diffusion(h: float) -> np.ndarray:
    """8 x 8 diffusion matrix of a cube with edge h: trilinear shapes, two Gauss points an axis."""
    corners = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], dtype=float)
    out, g = np.zeros((8, 8)), 3**-0.5
    for point in corners * g:
        one = 1 + corners * point
        slopes = np.stack([corners[:, k] * np.prod(np.delete(one, k, axis=1), axis=1) / 8 for k in range(3)], axis=1) * 2 / h
        out += slopes @ slopes.T * (h / 2) ** 3
    return out


def assemble(elements: DataFrame, h: float, source: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Diffusion matrix (row, col, val) and load (i, v) of equal cubes (elem, corner, node). Contributions add up before the shuffle."""
    spark, local = elements.sparkSession, hex_diffusion(h)
    table = spark.createDataFrame([(a, b, float(local[a, b])) for a in range(8) for b in range(8)], "corner int, other int, val double")  # 64 rows
    rows = elements.select("elem", F.col("corner").cast("int").alias("corner"), F.col("node").alias("row"))
    cols = elements.select("elem", F.col("corner").cast("int").alias("other"), F.col("node").alias("col"))
    matrix = rows.join(cols, "elem").join(F.broadcast(table), ["corner", "other"]).groupBy("row", "col").agg(F.sum("val").alias("val"))
    return matrix, elements.groupBy(F.col("node").alias("i")).agg((F.count("*") * source * h**3 / 8).alias("v"))


def face_series(points: DataFrame, terms: int = 60) -> DataFrame:
    """(i, v): the harmonic function of the unit cube that is 1 on the face x = 1 and 0 on the others, at points (i, x, y, z)."""
    k = points.sparkSession.range(terms * terms).select((F.expr(f"id div {terms}") * 2 + 1).alias("p"), (F.col("id") % terms * 2 + 1).alias("q"))
    rate = pi * F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    ratio = F.exp(rate * (F.col("x") - 1)) * (1 - F.exp(rate * F.col("x") * -2)) / (1 - F.exp(rate * -2))  # sinh(rate x) / sinh(rate) without overflow
    term = ratio * F.sin(F.col("p") * pi * F.col("y")) * F.sin(F.col("q") * pi * F.col("z")) / (F.col("p") * F.col("q"))
    return points.crossJoin(F.broadcast(k)).groupBy("i").agg((F.sum(term) * 16 / pi**2).alias("v"))  # terms ** 2 rows, a parameter


def residual(grid: DataFrame, rhs: DataFrame, axes: list[str]) -> DataFrame:
    """rhs - (2 d u - sum of neighbours), spacing 1."""
    sums = neighbour_sum(grid, star(len(axes)), axes)
    both = grid.join(sums, axes, "left").join(rhs.select(*axes, F.col("v").alias("f")), axes)
    return both.select(*axes, (F.col("f") - F.col("v") * (2 * len(axes)) + F.coalesce("s", F.lit(0.0))).alias("v"))


def multigrid_cycle(grid: DataFrame, rhs: DataFrame, axes: list[str], level: int, smooths: int = 2, cycles: int = 1, weight: float = 0.8) -> DataFrame:
    """A V cycle (cycles = 1) or W cycle (2) on 2 ** level - 1 inner points an axis; outside the grid is 0."""
    if level == 1:
        return rhs.select(*axes, (F.col("v") / (2 * len(axes))).alias("v"))
    relax = lambda g: cut_lineage(smooth(g, rhs, axes, weight, 1.0)[0])
    for _ in range(smooths):
        grid = relax(grid)
    coarse = cut_lineage(restrict(residual(grid, rhs, axes), axes))
    fix = coarse.withColumn("v", F.lit(0.0))
    for _ in range(cycles):
        fix = multigrid_cycle(fix, coarse, axes, level - 1, smooths, cycles, weight)
    grid = grid.join(prolong(fix, axes).withColumnRenamed("v", "_e"), axes, "left").select(*axes, (F.col("v") + F.coalesce("_e", F.lit(0.0))).alias("v"))
    for _ in range(smooths):
        grid = relax(grid)
    return grid


def substeps(outputs: list[float], h: float) -> list[tuple[float, bool]]:
    """Steps of h * h / 2 between output times, the last before each cut short to land on it: (step, is output)."""
    now, out = 0.0, []
    for t in outputs:
        while t - now > 1e-12:
            step = min(h * h / 2, t - now)
            now += step
            out.append((step, t - now <= 1e-12))
    return out


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def hex_volume(corners: Column) -> Column:
    """Volume of a hexahedron from its eight corners (arrays of three): twelve tetrahedra about the centroid's faces."""
    centre = [sum((corners[k][a] for k in range(1, 8)), corners[0][a]) / 8 for a in range(3)]
    faces, total = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)), F.lit(0.0)
    for face in faces:
        # A bilinear face's volume towards a point is the mean over its two splits into triangles.
        for t in (0, 1, 2, 3):
            p, q, r = ([corners[face[(t + s) % 4]][a] - centre[a] for a in range(3)] for s in (0, 1, 2))
            total = total + p[0] * (q[1] * r[2] - q[2] * r[1]) + p[1] * (q[2] * r[0] - q[0] * r[2]) + p[2] * (q[0] * r[1] - q[1] * r[0])
    return total / 12


def characteristic_length(corners: Column, volume: Column) -> Column:
    """Four volumes over the root of the largest face measure (16 times the squared area of a plane face)."""
    measures = []
    for a, b, c, d in ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)):
        u, v = _minus(corners[c], corners[a]), _minus(corners[d], corners[b])
        f, g = _minus(u, v), F.zip_with(u, v, lambda p, q: p + q)
        measures.append(_dot(f, f) * _dot(g, g) - _dot(f, g) * _dot(f, g))
    return volume * 4 / F.sqrt(F.greatest(*measures))


def pressure(energy: Column, compression: Column, volume: Column, low: float = 0.0, cut: float = 1e-7, most: float = 1e9) -> Column:
    """Two thirds (compression + 1) energy; 0 where it is below ``cut`` or the volume reaches ``most``; at least ``low``."""
    p = (compression + 1) * energy * 2 / 3
    return clamp(F.when((F.abs(p) < cut) | (volume >= most), F.lit(0.0)).otherwise(p), low=low)


def sound_speed(energy: Column, compression: Column, p: Column, volume: Column, density: float = 1.0) -> Column:
    """Squares up to 1.111111e-37 count as a speed of 3.333333e-19."""
    square = (energy * 2 / 3 + volume * volume * (compression + 1) * 2 / 3 * p) / density
    return F.when(square <= 1.111111e-37, F.lit(3.333333e-19)).otherwise(F.sqrt(square))


def slope_limiter(before: Column, after: Column, most: float = 1.0, factor: float = 2.0) -> Column:
    """Monotonic slope of two neighbours' gradients, in [0, most]."""
    return clamp(F.least((before + after) / 2, before * factor, after * factor), 0.0, most)


def deviatoric(df: DataFrame, xx: str = "dxx", yy: str = "dyy", zz: str = "dzz") -> DataFrame:
    """Adds vdov, the trace, and takes a third of it from each principal strain."""
    return df.withColumn("vdov", F.col(xx) + F.col(yy) + F.col(zz)).withColumns({c: F.col(c) - F.col("vdov") / 3 for c in (xx, yy, zz)})


def next_step(old: float, left: float, courant: float, hydro: float, low: float = 1.1, high: float = 1.2, most: float = 1e-2) -> float:
    """The time step after ``old``: half the courant limit, or two thirds of the hydro limit if that, whole, is smaller, growing by ``low`` to ``high`` or not at all, shaped so that no tiny step is left."""
    limit = courant / 2 if courant < 1e20 else 1e20
    step = hydro * 2 / 3 if hydro < limit else limit
    if step >= old:
        step = old if step < low * old else min(step, high * old)
    step = min(step, most)
    return min(step, 2 * step / 3 if step < left < 4 * step / 3 else left)


def student_quantiles(most: int = 200, share: float = 0.975) -> list[float]:
    """The ``share`` quantile of Student's t with 1 to ``most`` degrees of freedom, by integrating its density."""
    out = []
    angle = np.linspace(0, np.pi / 2, 40_001)[:-1]
    for n in range(1, most + 1):
        # With t = sqrt(n) tan(angle) the density is a power of the cosine.
        density = np.cos(angle) ** (n - 1)
        mass = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        out.append(float(np.sqrt(n) * np.tan(np.interp((2 * share - 1) * mass[-1], mass, angle))))
    return out


def ratio_interval(samples: DataFrame, keys: list[str], a: str, b: str, most: int = 200) -> DataFrame:
    """(keys, low, high): Fieller's 95 % interval of mean(a) / mean(b); beyond ``most`` values the quantile is a series in 1 / n."""
    t = samples.sparkSession.createDataFrame(list(enumerate(student_quantiles(most), 1)), "_n int, _t double")
    stats = samples.groupBy(*keys).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"), (F.stddev_samp(a) / F.sqrt(F.count(a))).alias("_sa"), (F.stddev_samp(b) / F.sqrt(F.count(b))).alias("_sb"), F.count(a).alias("_n"))
    q = F.col("_a") / F.col("_b")
    z, n = NormalDist().inv_cdf(0.975), F.col("_n")
    # Cornish and Fisher's expansion about the normal quantile; its error falls with the fourth power of n.
    series = z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * n**3)
    width = F.coalesce("_t", F.when(n > most, series)) * F.abs(q) * F.sqrt((F.col("_sa") / F.col("_a")) ** 2 + (F.col("_sb") / F.col("_b")) ** 2)
    return stats.filter("_n > 0").join(F.broadcast(t), "_n", "left").select(*keys, (q - width).alias("low"), (q + width).alias("high"))


def signed_ranks(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, w_plus, w_minus, t): Wilcoxon's signed rank sums, ties sharing their mean rank and zeros left out; and the paired t statistic."""
    # Equal differences are counted first, so a window sees one row for each size of difference.
    d = F.col(a) - F.col(b)
    t = pairs.groupBy(*keys).agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))
    sizes = pairs.withColumn("_d", F.abs(d)).filter("_d > 0").groupBy(*keys, "_d").agg(F.count("*").alias("_n"), F.sum(F.when(d > 0, 1).otherwise(0)).alias("_up"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d"))
    ranked = sizes.withColumn("_rank", upto - (F.col("_n") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("_n") - F.col("_up"))).alias("w_minus"))
    return sums.join(t, keys)
