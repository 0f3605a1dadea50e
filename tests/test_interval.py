"""Intervals of large groups take the quantile of their own size."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields


def test_large_groups(spark):
    x = spark.range(1_000).select(F.lit(1).alias("k"), (F.col("id") % 7 + 1).cast("double").alias("a"), (F.col("id") % 5 + 1).cast("double").alias("b"))
    exact = fields.ratio_interval(x, ["k"], "a", "b", most=1_000).first()
    assert tuple(fields.ratio_interval(x, ["k"], "a", "b").first()) == pytest.approx(tuple(exact), rel=1e-7)
    assert fields.student_quantiles(1_000)[-1] == pytest.approx(1.962339, abs=1e-5)
