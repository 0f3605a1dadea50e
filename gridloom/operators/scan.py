"""Thresholds from prefix sums, strided selection, cost zones, sorting and its verification.

No global window runs over data: ranks come from the rows of sorted partitions plus the sums of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """0-based positions in the total order: a range shuffle, a local count and the counts before (a row per partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    local = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_k") - 1 + F.col("_before")).cast("long")).drop("_p", "_k", "_before")  # as many rows as partitions


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def top_percent_threshold(matrix: DataFrame, percent: int, value: str = "v") -> DataFrame:
    """One row (t): values from the largest down are taken while the count before them is at most total * percent div 100."""
    counts = matrix.groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc(value))
    taken = counts.select(value, (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return taken.filter(F.col("before") <= F.expr(f"total * {percent} div 100")).agg(F.min(value).alias("t"))


def threshold_mask(matrix: DataFrame, percent: int, value: str = "v") -> DataFrame:
    t = top_percent_threshold(matrix, percent, value)
    return matrix.join(F.broadcast(t)).select("r", "c", (F.col(value) >= F.col("t")).alias("keep"))  # t: one row


def strided_selection(points: DataFrame, n: int, value: str = "v") -> DataFrame:
    """(i, r, c): of the points in order of value, row and column every (count div n)-th, n of them; with fewer points than n the first one n times."""
    ranked = global_rank(points, F.col(value), F.col("r"), F.col("c"))
    chunk = points.agg(F.expr(f"count(*) div {n}").cast("long").alias("chunk"))
    joined = ranked.join(F.broadcast(chunk))  # one row
    spaced = joined.filter((F.col("chunk") > 0) & (F.expr("rank % chunk") == 0) & (F.expr("rank div chunk") < n)).select(F.expr("rank div chunk").alias("i"), "r", "c")
    same = joined.filter((F.col("chunk") == 0) & (F.col("rank") == 0)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"), "r", "c")
    return spaced.unionByName(same)


def winnow(matrix: DataFrame, mask: DataFrame, n: int) -> DataFrame:
    return strided_selection(matrix.join(mask.filter("keep"), ["r", "c"]), n)


def cost_zones(df: DataFrame, order: str, cost: str, zones: int) -> DataFrame:
    """Each row's zone: running cost before it * zones div total cost; running sums are taken by partition of the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id())
    local = placed.withColumn("_s", F.sum(cost).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy("_p").agg(F.sum(cost).alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_t"))
    out = local.join(F.broadcast(sums), "_p")  # as many rows as partitions
    return out.withColumn("zone", F.least(F.expr(f"({'_s'} + _b - {cost}) * {zones} div _t"), F.lit(zones - 1)).cast("long")).drop("_p", "_s", "_b", "_t")


def bucket_sort(keys: DataFrame, key: str, buckets: int, max_key: int) -> DataFrame:
    """Keys with their bucket (key div width), each bucket in one sorted partition."""
    width = -(-max_key // buckets)
    return keys.withColumn("bucket", F.expr(f"{key} div {width}")).repartitionByRange(buckets, "bucket").sortWithinPartitions("bucket", key)


def verify_buckets(sorted_: DataFrame, key: str, buckets: int, max_key: int) -> DataFrame:
    """(bucket, n, in_range, distinct_total): every key in its bucket's range, and key counts that add up to the bucket's size."""
    width = -(-max_key // buckets)
    counts = sorted_.groupBy("bucket", key).agg(F.count("*").alias("_count"))
    ok = (F.col(key) >= F.col("bucket") * width) & (F.col(key) < (F.col("bucket") + 1) * width)
    return counts.groupBy("bucket").agg(F.sum("_count").alias("n"), F.min(ok.cast("int")).alias("in_range"), F.count("*").alias("distinct_keys"))


def counting_sort(sorted_: DataFrame, key: str) -> DataFrame:
    return sorted_.groupBy("bucket", key).agg(F.count("*").alias("n"))
