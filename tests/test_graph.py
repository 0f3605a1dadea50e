"""Paths end where the graph does, and a cycle is an error."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph
from gridloom.sources import formats


def path(spark, n):
    return spark.range(n).select("id"), spark.range(n - 1).select(F.col("id").alias("tail"), (F.col("id") + 1).alias("head"))


def test_levels(spark):
    assert graph.levels.__defaults__ == graph.explore.__defaults__ == (None,)
    assert {tuple(r) for r in graph.levels(*path(spark, 12)).collect()} == {(k, k) for k in range(12)}
    with pytest.raises(ValueError):
        graph.levels(*path(spark, 12), most=5)
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "tail long, head long")
    with pytest.raises(ValueError):
        graph.levels(spark.range(3), ring)


def test_deep_tree(spark, tmp_path):
    doc = {"scope": "s"}
    for _ in range(34):
        doc = {"scope": "s", "domains": {"d": doc}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    assert formats.read_json_tree(spark, str(tmp_path / "t.json")).agg(F.max("depth")).first()[0] == 34
