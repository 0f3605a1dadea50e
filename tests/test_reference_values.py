"""Published inputs and results."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph, linalg, scan, stencil
from gridloom.plans.chain import seeded_chain
from gridloom.sources import formats, generators

M = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 3), (1, 1, 2), (1, 2, 1)]


def matrix(spark):
    return spark.createDataFrame(M, "r long, c long, v int")


@pytest.mark.parametrize("percent,t", [(0, 3), (33, 3), (34, 2), (66, 2), (67, 1), (100, 1)])
def test_threshold(spark, percent, t):
    assert scan.top_percent_threshold(matrix(spark), percent).first()["t"] == t


@pytest.mark.parametrize("off,n,want", [([], 6, [(0, 0), (1, 2), (0, 1), (1, 1), (0, 2), (1, 0)]), ([], 3, [(0, 0), (0, 1), (0, 2)]), ([(0, 0)], 3, [(1, 2), (0, 1), (1, 1)]), ([(0, 0)], 2, [(1, 2), (1, 1)]), ([], 9, [(0, 0)] * 9)])
def test_winnow(spark, off, n, want):
    mask = spark.createDataFrame([(r, c, (r, c) not in off) for r, c, _ in M], "r long, c long, keep boolean")
    assert [(x.r, x.c) for x in scan.winnow(matrix(spark), mask, n).orderBy("i").collect()] == want


def test_chain(spark):
    got = [x.v for x in seeded_chain(spark, 5, 666, 50, 6).orderBy("i").collect()]
    assert got == pytest.approx([128.549, 157.537, 178.934, 184.571, 121.517, 117.32], abs=1e-3)


def test_product(spark):
    a = spark.createDataFrame([(i, j, 4.0 * i + j + 1) for i in range(4) for j in range(4)], "i long, j long, d double")
    v = spark.createDataFrame(list(enumerate([1.01, 2.2, 3.3, 4.4])), "i long, v double")
    assert [x.v for x in linalg.mat_vec(a, v).orderBy("i").collect()] == pytest.approx([32.91, 76.55, 120.19, 163.83])


def test_conjugate_gradient_finds_ones(spark):
    a = generators.stencil_matrix(spark, 3, 3, 2)
    x, k, _ = linalg.conjugate_gradient(a, generators.stencil_rhs(a), max_iter=12, tol=1e-9)
    assert k <= 12 and x.agg(F.max(F.abs(F.col("v") - 1))).first()[0] < 1e-6


def test_heat_keeps_energy(spark):
    g = generators.block_field(spark, 12, 12, 4)
    assert stencil.heat(g, ["r", "c"], 3, [12, 12]).agg(F.sum("v")).first()[0] == pytest.approx(16.0)


def test_puzzle_moves(spark):
    start = spark.createDataFrame([("012345678",)], "state string")
    assert {x.state for x in graph.puzzle_moves(start).collect()} == {"102345678", "312045678"}
    assert graph.explore(start, graph.puzzle_moves, most=4).filter("cost < 4").count() == 1 + 2 + 4 + 8


def test_files_come_back(spark, tmp_path):
    a = generators.stencil_matrix(spark, 2, 2, 2)
    formats.write_mtx(a, str(tmp_path / "a.mtx"))
    assert sorted(map(tuple, formats.read_mtx(spark, str(tmp_path / "a.mtx")).collect())) == sorted(map(tuple, a.collect()))
