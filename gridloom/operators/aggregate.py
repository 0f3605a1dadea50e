"""Histograms, statistics of measurements and other aggregations. All reduce partially before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def binned_histogram(df: DataFrame, value: Column, bins: int, top: int) -> DataFrame:
    """(bin, n) with bin = value * bins div top; empty bins are kept."""
    counts = df.groupBy(F.floor(value * bins / top).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def render_histogram(histogram: DataFrame, width: int = 60) -> DataFrame:
    """Bars of the counts and their running sum."""
    most = histogram.agg(F.max("n").alias("most"))
    bars = histogram.join(F.broadcast(most))  # one row
    return bars.select("bin", "n", F.expr(f"repeat('#', cast(n * {width} div most as int))").alias("bar"), F.sum("n").over(Window.orderBy("bin")).alias("running"))


def min_max_with_location(df: DataFrame, value: str, *location: str) -> DataFrame:
    """Smallest and largest value and where they are; ties go to the smallest location."""
    where = F.struct(*location)
    return df.agg(F.min(value).alias("min_v"), F.min(F.struct(F.col(value), where)).getField("col2").alias("at_min"), F.max(value).alias("max_v"), F.max_by(where, F.struct(F.col(value), *(-F.col(c) for c in location))).alias("at_max"))


def bucket_counts(df: DataFrame, unit: Column, bucket: Column) -> DataFrame:
    return df.groupBy(unit.cast("long").alias("pe"), bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def dot(x: DataFrame, y: DataFrame, key: str = "i", value: str = "v") -> DataFrame:
    return x.join(y.select(key, F.col(value).alias("_w")), key).agg(F.sum(F.col(value) * F.col("_w")).alias("dot"))


def squared_norm(x: DataFrame, value: str = "v") -> DataFrame:
    return x.agg(F.sum(F.col(value) * F.col(value)).alias("sq_norm"))


def max_abs_diff(x: DataFrame, y: DataFrame, key: str = "i", value: str = "v") -> DataFrame:
    return x.join(y.select(key, F.col(value).alias("_w")), key).agg(F.max(F.abs(F.col(value) - F.col("_w"))).alias("max_abs_diff"))


def repeat_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, upper median (element n div 2 of the sorted values) and max by key, by rank rather than a collected list."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.select(*keys, value, (F.row_number().over(w) - 1).alias("_k"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return ranked.groupBy(*keys).agg(F.min(value).alias("min_v"), F.max(F.when(F.col("_k") == F.expr("_n div 2"), F.col(value))).alias("median_v"), F.max(value).alias("max_v"))


def call_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), (F.sum(value) / F.count("*")).alias("avg_v"))


def spread(df: DataFrame, proc: str, value: str) -> DataFrame:
    """min (first proc that has it), max (last proc), mean, load imbalance % and deviation % of a value per proc."""
    out = df.agg(
        F.min(value).alias("min_v"), F.min_by(proc, F.struct(value, proc)).alias("min_proc"), F.max(value).alias("max_v"), F.max_by(proc, F.struct(value, proc)).alias("max_proc"),
        F.avg(value).alias("avg_v"), F.sum(value).alias("sum_v"), F.stddev_samp(value).alias("_s"),
    )
    off = F.greatest(F.abs(F.col("min_v") - F.col("avg_v")), F.abs(F.col("max_v") - F.col("avg_v")))
    return out.select("min_v", "min_proc", "max_v", "max_proc", "avg_v", "sum_v", (off / F.col("avg_v") * 100).alias("imbalance_pct"), (F.col("_s") / F.col("avg_v") * 100).alias("stddev_pct"))


def conditional_min(df: DataFrame, group: str, value: str, condition: Column) -> DataFrame:
    return df.groupBy(group).agg(F.min(F.when(condition, F.col(value))).alias("min_v"))


def symmetry_error(grid: DataFrame, row: str = "r", col: str = "c", value: str = "v") -> DataFrame:
    """Largest and total difference between (j, k) and (k, j), and the largest relative one."""
    other = grid.select(F.col(col).alias(row), F.col(row).alias(col), F.col(value).alias("_w"))
    d = F.abs(F.col(value) - F.col("_w"))
    return grid.join(other, [row, col]).filter(F.col(row) < F.col(col)).agg(F.max(d).alias("max_diff"), F.sum(d).alias("total_diff"), F.max(F.when(F.col("_w") != 0, d / F.abs("_w"))).alias("max_rel_diff"))


def rank_against_best(df: DataFrame, problem: str, language: str, value: str) -> DataFrame:
    """Mean over problems of a language's value over the best language's."""
    best = F.min(value).over(Window.partitionBy(problem))
    return df.withColumn("_x", F.col(value) / best).groupBy(language).agg(F.avg("_x").alias("rank"))


def speed_up(df: DataFrame, keys: list[str], threads: str, value: str) -> DataFrame:
    """Mean at one thread over mean at each number of threads."""
    means = df.groupBy(*keys, threads).agg(F.avg(value).alias("_m"))
    base = F.max(F.when(F.col(threads) == 1, F.col("_m"))).over(Window.partitionBy(*keys))
    return means.select(*keys, threads, (base / F.col("_m")).alias("speed_up"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"), (F.count(d) - 1).alias("df"))


def flop_rollup(df: DataFrame) -> DataFrame:
    """Operations and MFLOPS of a solver from rows, nnz, iterations and seconds (n, nnz, iters, ddot_s, waxpby_s, spmv_s)."""
    ops = [("ddot", 4 * F.col("n")), ("waxpby", 6 * F.col("n")), ("spmv", 2 * F.col("nnz"))]
    df = df.select("*", *((o * F.col("iters")).alias(f"{k}_ops") for k, o in ops))
    return df.select("*", *((F.col(f"{k}_ops") / F.col(f"{k}_s") / 1e6).alias(f"{k}_mflops") for k, _ in ops))


def conservation(bodies: DataFrame) -> DataFrame:
    """Mass, kinetic and potential energy and angular momentum in one pass."""
    m, pos, vel = F.col("mass"), [F.col(c) for c in ("x", "y", "z")], [F.col(c) for c in ("vx", "vy", "vz")]
    l_ = lambda i, j: F.sum(m * (pos[i] * vel[j] - pos[j] * vel[i]))
    return bodies.agg(F.sum(m).alias("mass"), F.sum(0.5 * m * sum((v * v for v in vel), F.lit(0.0))).alias("kinetic"), F.sum(0.5 * m * F.col("phi")).alias("potential"), l_(1, 2).alias("lx"), l_(2, 0).alias("ly"), l_(0, 1).alias("lz"))
