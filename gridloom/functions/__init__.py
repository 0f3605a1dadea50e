"""Column functions: clamping, snapping, complex numbers, 3-vectors, octants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def snap(x: Column, to: float, within: float) -> Column:
    """``to`` where x is closer to it than ``within``, else x."""
    return F.when(F.abs(x - to) < within, F.lit(to)).otherwise(x)


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def evolve(a: Column, factor: Column) -> Column:
    """A complex value times a real one."""
    return complex_(a["re"] * factor, a["im"] * factor)


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vec_scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * (k if isinstance(k, Column) else F.lit(k)))


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def signed_wrap(i: Column, n: int) -> Column:
    """Frequency of index i in a transform of length n: negative in the upper half."""
    return F.pmod(i + n // 2, F.lit(n)) - n // 2


def octant_path(x: Column, y: Column, z: Column, low: float, size: float, levels: int) -> Column:
    """Digits 0 to 7 of the octants that hold a point, from the root of a cube at ``low`` down."""
    cell = [F.floor((c - low) / size * (1 << levels)).cast("long") for c in (x, y, z)]
    return F.concat(*[(F.shiftright(cell[0], k).bitwiseAND(1) * 4 + F.shiftright(cell[1], k).bitwiseAND(1) * 2 + F.shiftright(cell[2], k).bitwiseAND(1)).cast("string") for k in range(levels - 1, -1, -1)])


def owner(key: Column, units: int, max_key: int) -> Column:
    """The bucket of a key when [0, max_key) is cut into ``units`` equal ranges."""
    return F.floor(key / F.lit(-(-max_key // units))).cast("long")
