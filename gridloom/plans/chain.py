"""The chain: matrix, threshold, selection, distances, product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg, scan
from ..sources.generators import random_matrix


def chain(matrix: DataFrame, percent: int, n: int) -> DataFrame:
    """(i, v): distances between n points of the top ``percent``, times their distances from the origin."""
    mask = scan.threshold_mask(matrix, percent)
    points = scan.winnow(matrix, mask, n).withColumn("r", F.col("r").cast("double")).withColumn("c", F.col("c").cast("double"))
    return linalg.mat_vec(linalg.distances(points), linalg.origin_distance(points))


def seeded_chain(spark: SparkSession, size: int, seed: int, percent: int, n: int) -> DataFrame:
    return chain(random_matrix(spark, size, size, seed), percent, n)
