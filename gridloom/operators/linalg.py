"""Distances, dense and sparse products, gather and scatter, boundary rows and conjugate gradients."""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import cut_lineage


def distances(points: DataFrame, coords: list[str] = ("r", "c"), squared: bool = False) -> DataFrame:
    """(i, j, d) of all ordered pairs; on the diagonal the number of points times the row's largest distance."""
    b = points.select(F.col("i").alias("j"), *(F.col(c).alias(f"_{c}") for c in coords))
    d = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in coords), F.lit(0))
    pairs = points.crossJoin(b).select("i", "j", (d if squared else F.sqrt(d)).alias("d"))  # the operator is the product itself
    w = Window.partitionBy("i")
    return pairs.select("i", "j", F.when(F.col("i") == F.col("j"), F.count("*").over(w) * F.max("d").over(w)).otherwise(F.col("d")).alias("d"))


def farthest(points: DataFrame, coords: list[str] = ("r", "c"), squared: bool = False) -> DataFrame:
    """(i, d): the diagonal of ``distances`` alone, one row per id, without the product of all pairs. Of doubles, to rounding."""
    far = corners(points, coords).select(*(F.col(c).alias(f"_{c}") for c in coords))
    d = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in coords), F.lit(0))
    rows = points.select("i", *coords).join(F.broadcast(far), F.lit(True), "left").groupBy("i").agg(F.max(d if squared else F.sqrt(d)).alias("d"))
    return rows.crossJoin(F.broadcast(points.agg(F.count("*").alias("_n")))).select("i", (F.col("_n") * F.col("d")).alias("d"))


def corners(points: DataFrame, coords: list[str] = ("r", "c")) -> DataFrame:
    """Points among which every point's farthest is: in the plane the corners of the convex hull, else all distinct ones."""
    at = points.select(*coords)
    if len(coords) != 2 or any(kind.startswith("decimal") for _, kind in at.dtypes):
        return at.distinct()
    return at.mapInArrow(_corners, at.schema).repartition(1).mapInArrow(_corners, at.schema)  # first of each partition, then of those


def _corners(batches):
    kept, odd, schema = set(), set(), None
    for b in batches:
        schema, seen = b.schema, {p for p in zip(*(c.to_pylist() for c in b.columns), strict=True) if None not in p}
        wild = {p for p in seen if not all(map(math.isfinite, p))}
        odd |= {tuple(0 if math.isfinite(v) else math.nan if v != v else v for v in p) for p in wild}  # any finite value gives the same distances
        kept = _hull(sorted(kept | (seen - wild)))
    if rows := [*kept, *odd]:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _hull(at: list[tuple]) -> set[tuple]:
    """Corners of the convex hull of sorted distinct points."""
    out = set()
    for walk in (at, at[::-1]):
        side = []
        for p in walk:
            while len(side) > 1 and not _left(side[-2], side[-1], p):
                side.pop()
            side.append(p)
        out.update(side)
    return out


def _left(o: tuple, a: tuple, b: tuple) -> bool:
    """Whether the way from o over a to b turns left; where rounding could decide, by fractions."""
    s, t = (a[0] - o[0]) * (b[1] - o[1]), (a[1] - o[1]) * (b[0] - o[0])
    if isinstance(s - t, float) and not abs(s - t) > 1e-15 * (abs(s) + abs(t)):
        o, a, b = (tuple(map(Fraction, p)) for p in (o, a, b))
        s, t = (a[0] - o[0]) * (b[1] - o[1]), (a[1] - o[1]) * (b[0] - o[0])
    return s > t


def origin_distance(points: DataFrame) -> DataFrame:
    return points.select("i", F.sqrt(F.col("r") * F.col("r") + F.col("c") * F.col("c")).alias("v"))


def mat_vec(matrix: DataFrame, vector: DataFrame, row: str = "i", col: str = "j", value: str = "d") -> DataFrame:
    """(i, v): dense or sparse; Spark broadcasts the vector where its size allows it."""
    x = vector.select(F.col("i").alias(col), F.col("v").alias("_x"))
    return matrix.join(x, col).groupBy(F.col(row).alias("i")).agg(F.sum(F.col(value) * F.col("_x")).alias("v"))


def spmv(coo: DataFrame, vector: DataFrame) -> DataFrame:
    return mat_vec(coo, vector, "row", "col", "val")


def waxpby(alpha, x: DataFrame, beta, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("_y")), "i").select("i", (F.lit(alpha) * F.col("v") + F.lit(beta) * F.col("_y")).alias("v"))


def gather(bridge: DataFrame, values: DataFrame, group: str, child: str, order: str, value: str) -> DataFrame:
    """Each element's child values in corner order."""
    return bridge.join(values, child).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, child, value))), lambda s: s[value]).alias("corners"))


def scatter_add(bridge: DataFrame, values: DataFrame, element: str, node: str, value: str) -> DataFrame:
    return bridge.join(values, element).groupBy(node).agg(F.sum(value).alias("total"))


def dirichlet(coo: DataFrame, rhs: DataFrame, boundary: DataFrame, prescribed: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows of ``boundary`` (i) become identity rows; other rows lose those columns, which move to the right-hand side."""
    rows, cols = boundary.select(F.col("i").alias("row")), boundary.select(F.col("i").alias("col"))
    inner = coo.join(rows, "row", "left_anti")
    moved = inner.join(cols, "col", "left_semi").groupBy(F.col("row").alias("i")).agg(F.sum("val").alias("_m"))
    identity = boundary.select(F.col("i").alias("row"), F.col("i").alias("col"), F.lit(1).cast(coo.schema["val"].dataType).alias("val"))
    b = rhs.join(boundary.withColumn("_b", F.lit(True)), "i", "left").join(moved, "i", "left")
    b = b.select("i", F.when(F.col("_b"), F.lit(prescribed)).otherwise(F.col("v") - F.coalesce("_m", F.lit(0)) * prescribed).alias("v"))
    return inner.join(cols, "col", "left_anti").select("row", "col", "val").unionByName(identity), b


def externals(coo: DataFrame, owner_rows: int) -> DataFrame:
    """(owner, col, col_owner): columns that a range of rows needs and doesn't own."""
    o = coo.select(F.expr(f"row div {owner_rows}").alias("owner"), "col", F.expr(f"col div {owner_rows}").alias("col_owner"))
    return o.filter("owner <> col_owner").distinct()


def conjugate_gradient(coo: DataFrame, b: DataFrame, max_iter: int = 149, tol: float = 0.0, cut_every: int = 5) -> tuple[DataFrame, int, float]:
    """(x, iterations, residual norm) for a symmetric positive definite matrix, from x = 0. Vectors are one table; lineage is cut every few steps."""
    state = cut_lineage(b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    k = 0
    while k < max_iter and rr**0.5 > tol and rr > 1e-300:
        ap = spmv(coo, state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("ap"))
        joined = cut_lineage(state.join(ap, "i"))
        alpha = rr / joined.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = joined.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = moved.select("i", "x", "r", (F.col("r") + new / rr * F.col("p")).alias("p"))
        rr, k = new, k + 1
    return state.select("i", F.col("x").alias("v")), k, rr**0.5
