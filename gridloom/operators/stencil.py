"""Neighbour sums on grids and what is made of them: heat, smoothing, restriction, prolongation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import cut_lineage


def neighbour_sum(grid: DataFrame, offsets: list[tuple], axes: list[str], extents: list[int] | None = None, value: str = "v") -> DataFrame:
    """(axes, s): each cell's weighted sum of its neighbours. offsets: (shift for each axis ..., weight).

    With ``extents`` the grid is cyclic, else cells outside count as 0. One shuffle with partial sums, whatever the
    number of offsets.
    """
    moves = F.explode(F.array(*(F.struct(*(F.lit(int(s)).alias(f"d{k}") for k, s in enumerate(o[:-1])), F.lit(o[-1]).alias("w")) for o in offsets)))
    spread = grid.select(*axes, value, moves.alias("o"))
    at = [F.col(a) - F.col(f"o.d{k}") if extents is None else F.pmod(F.col(a) - F.col(f"o.d{k}"), F.lit(extents[k])) for k, a in enumerate(axes)]
    return spread.select(*(x.alias(a) for x, a in zip(at, axes, strict=True)), (F.col(value) * F.col("o.w")).alias("_s")).groupBy(*axes).agg(F.sum("_s").alias("s"))


def star(dims: int) -> list[tuple]:
    return [tuple(d if k == a else 0 for k in range(dims)) + (1,) for a in range(dims) for d in (-1, 1)]


def apply_stencil(grid: DataFrame, axes: list[str], centre: int | float, extents: list[int] | None = None, scale: int | float = 1) -> DataFrame:
    """centre * v + scale * (sum of the star's neighbours), on the grid's own cells."""
    sums = neighbour_sum(grid, star(len(axes)), axes, extents)
    return grid.join(sums, axes, "left").select(*axes, (F.col("v") * centre + F.coalesce("s", F.lit(0)) * scale).alias("v"))


def heat(grid: DataFrame, axes: list[str], steps: int, extents: list[int] | None, dt: float = 0.05, k: float = 1.0, cut_every: int = 5) -> DataFrame:
    """Explicit heat steps: v + k dt (sum of second differences). Cyclic grids keep their energy."""
    for step in range(steps):
        grid = apply_stencil(grid, axes, 1 - 2 * len(axes) * k * dt, extents, k * dt)
        if (step + 1) % cut_every == 0:
            grid = cut_lineage(grid)
    return grid


def smooth(grid: DataFrame, rhs: DataFrame, axes: list[str], weight: float, h: float) -> tuple[DataFrame, DataFrame]:
    """A weighted Jacobi step for -laplace u = rhs; and one row with the largest change."""
    d = 2 * len(axes)
    sums = neighbour_sum(grid, star(len(axes)), axes)
    new = (F.coalesce("s", F.lit(0.0)) + F.col("f") * h * h) / d
    out = grid.join(sums, axes, "left").join(rhs.select(*axes, F.col("v").alias("f")), axes).select(*axes, "v", (F.col("v") + weight * (new - F.col("v"))).alias("u"))
    return out.select(*axes, F.col("u").alias("v")), out.agg(F.max(F.abs(F.col("u") - F.col("v"))).alias("residual"))


def restrict(grid: DataFrame, axes: list[str], factor: int | float = 4) -> DataFrame:
    """Injection at odd points times ``factor``."""
    on = grid
    for a in axes:
        on = on.filter(F.col(a) % 2 == 1)
    return on.select(*(F.expr(f"{a} div 2").alias(a) for a in axes), (F.col("v") * factor).alias("v"))


def prolong(grid: DataFrame, axes: list[str], unit: int | float = 1.0) -> DataFrame:
    """Each coarse point adds to the fine points around 2 c + 1, with weight unit / 2 ** (number of axes moved)."""
    offsets = [()]
    for _ in axes:
        offsets = [(*o, d) for o in offsets for d in (-1, 0, 1)]
    weighted = [(*o, unit // 2 ** sum(map(abs, o)) if isinstance(unit, int) else unit / 2 ** sum(map(abs, o))) for o in offsets]
    fine = grid.select(*((F.col(a) * 2 + 1).alias(a) for a in axes), "v")
    return neighbour_sum(fine, weighted, axes).withColumnRenamed("s", "v")
