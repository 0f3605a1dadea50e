"""Each point's largest distance against brute force, without the product of all pairs."""

import math

import numpy as np
import pytest

from gridloom.operators import linalg
from gridloom.plans import catalogue


def brute(at):
    """{i: points times largest distance} for (i, x, y) in whole numbers."""
    p = np.array([a[1:] for a in at], dtype=object)
    return {i: len(at) * max((p[:, 0] - x) ** 2 + (p[:, 1] - y) ** 2) for i, x, y in at}


def test_whole_outer_diag_makes_no_pairs(spark, tmp_path):
    rng = np.random.default_rng(7)
    e = [(i, [float(np.float32(v)) for v in rng.normal(size=2) / 8]) for i in range(1_500)]
    spark.createDataFrame(e, "vec_id long, embedding array<float>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalogue.QUERIES["whole_outer_diag"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan
    at = [(i, *(int(math.copysign(math.floor(abs(x * 1000) + 0.5), x)) for x in v)) for i, v in e]
    assert {i: d for i, d in df.collect()} == brute(at)
    assert linalg.corners(spark.createDataFrame(at, "i long, x long, y long"), ["x", "y"]).count() < 60


@pytest.mark.parametrize("kind", ["long", "double"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(8)
    ring = [(round(1e6 * math.cos(k / 50)), round(1e6 * math.sin(k / 50))) for k in range(300)]
    line = [(3 * k, 7 * k) for k in range(200)]
    square = [(x, y) for x in range(12) for y in range(12)]
    copies = [(5, 5)] * 40 + [(-9, 2)] * 3
    for xy in (ring, line, square, copies, [(4, 4)], ring + square, rng.integers(-3, 4, (200, 2)).tolist()):
        at = [(i, int(x), int(y)) for i, (x, y) in enumerate(xy)]
        df = spark.createDataFrame([(i, *((float(v) if kind == "double" else v) for v in p)) for i, *p in at], f"i long, x {kind}, y {kind}")
        assert {i: d for i, d in linalg.farthest(df, ["x", "y"], squared=True).collect()} == brute(at)


def test_as_the_diagonal_of_distances(spark):
    rng = np.random.default_rng(9)
    at = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(150, 3)))] + [(200, 0.1, 0.1, 0.1), (201, 0.3, 0.3, 0.3), (202, 0.2, 0.2, 0.2), (203, None, 1.0, 1.0)]
    df = spark.createDataFrame(at, "i long, x double, y double, z double")
    for coords in (["x", "y"], ["y", "z"], ["x", "y", "z"], ["x"]):
        want = dict(linalg.distances(df, coords).filter("i = j").select("i", "d").collect())
        got = dict(linalg.farthest(df, coords).collect())
        assert got.keys() == want.keys() and (got[203] is None) == (want[203] is None)
        assert all(d == pytest.approx(want[i], rel=1e-14) for i, d in got.items() if d is not None)


def test_odd_points(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, math.inf, 1.0)], "i long, x double, y double")
    got = dict(linalg.farthest(df, ["x", "y"]).collect())
    assert got[0] == got[1] == math.inf and math.isnan(got[2])
    got = dict(linalg.farthest(df.union(spark.sql("SELECT 3L, double('NaN'), 0d")), ["x", "y"]).collect())
    assert len(got) == 4 and all(map(math.isnan, got.values()))
    assert linalg.farthest(df.filter("false"), ["x", "y"]).collect() == []
    same = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (2, 5, 0)], "i long, x long, y long")  # one row per id, as GROUP BY gives
    assert sorted(map(tuple, linalg.farthest(same, ["x", "y"], squared=True).collect())) == [(1, 3 * 29), (2, 3 * 29)]
