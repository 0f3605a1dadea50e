"""The queries over whole tables against brute force, on rows beyond the parts that the queries with SQL read."""

from collections import deque
from math import pi, sin, sinh, sqrt

import numpy as np
import pytest

from gridloom.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = np.random.default_rng(4), str(tmp_path_factory.mktemp("whole"))
    orders = [(i, int(rng.integers(0, 99)), float(rng.integers(0, 9_999))) for i in range(4_000) if i % 11 or i < 100]
    embeddings = [(i, [float(np.float32(x)) for x in rng.normal(size=3)], i % 7) for i in range(90)]
    part = [(i, i * 3 % 50) for i in range(1, 80)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    return d, orders, embeddings, part


def got(spark, tables, name):
    return [tuple(r) for r in catalogue.QUERIES[f"whole_{name}"](spark, tables[0]).collect()]


def cells(tables):
    return {(k // 100, k % 100): int(p) % 100 for k, _, p in tables[1]}


def test_pairs(spark, tables):
    at = {i: [int(np.floor(abs(x * 1000) + 0.5) * np.sign(x)) for x in e] for i, e, _ in tables[2]}
    far = {i: 90 * max((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for b in at.values()) for i, a in at.items()}
    assert dict(got(spark, tables, "outer_diag")) == far
    want = {}
    for i, a in at.items():
        s = {j: sum((q - p) ** 2 for p, q in zip(a, b, strict=True)) / 1e4 + 0.25 for j, b in at.items() if j != i}
        mass = {j: j % 7 % 5 + 1 for j in s}
        want[i] = [-sum(mass[j] / sqrt(s[j]) for j in s), *(sum(mass[j] / s[j] ** 1.5 * (at[j][k] - a[k]) / 100 for j in s) for k in range(3))]
    for i, *v in (rows := got(spark, tables, "gravity_pairs")):
        assert v == pytest.approx(want[i], abs=2e-5)
    assert len(rows) == 90


def test_grids(spark, tables):
    g, want = cells(tables), {}
    for (r, c), v in g.items():
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                at = 2 * r + 1 - i, 2 * c + 1 - j
                want[at] = want.get(at, 0) + v * 64 // 2 ** (abs(i) + abs(j))
    assert {(r, c): v for r, c, v in got(spark, tables, "prolong_int")} == want
    heat = dict(g)
    for _ in range(3):
        heat = {(r, c): 16 * v + sum(heat.get(((r + i) % 40, (c + j) % 100), 0) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))) for (r, c), v in heat.items()}
    assert {(r, c): v for r, c, v in got(spark, tables, "heat_k_steps")} == heat
    left, sizes = {x for x, v in g.items() if v >= 80}, {}
    while left:
        first = min(left)
        todo, n = [first], 0
        left.discard(first)
        while todo:
            r, c = todo.pop()
            n += 1
            near = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
            left -= near
            todo += near
        sizes[first[0] * 100 + first[1]] = n
    assert dict(got(spark, tables, "components")) == sizes


def test_graphs(spark, tables):
    links = {}
    for k, c, _ in tables[1]:
        links.setdefault(c % 50, set()).add(k % 60 + 100)
        links.setdefault(k % 60 + 100, set()).add(c % 50)
    cost, todo = {0: 0}, deque([0])
    while todo:
        a = todo.popleft()
        for b in links[a] - cost.keys():
            cost[b] = cost[a] + 1
            todo.append(b)
    assert dict(got(spark, tables, "bfs_levels")) == cost
    arcs = {(c % 40, c % 40 + 1 + k % 9) for k, c, _ in tables[1]}
    level = {}
    for n in sorted({x for a in arcs for x in a}):
        level[n] = max((level[t] + 1 for t, h in arcs if h == n), default=0)
    assert dict(got(spark, tables, "dag_levels")) == level


def test_cubes(spark, tables):
    cube = np.zeros((40, 10, 10))
    for k, _, p in tables[1]:
        cube[k // 100, k // 10 % 10, k % 10] = int(p) % 100
    want = sum(cube[j * 5 % 40, j * 3 % 10, j % 10] for j in range(1, 1025)) / cube.size
    assert got(spark, tables, "strided_checksum") == [(pytest.approx(want), 0.0)]
    whole, rows = np.fft.fftn(cube), got(spark, tables, "fourier_cube")
    assert len(rows) == cube.size and all(abs(re + 1j * im - whole[z, y, x]) < 1e-3 for z, y, x, re, im in rows)


def test_series(spark, tables):
    odd = range(1, 24, 2)
    term = lambda p, q, y, z: sinh(pi * sqrt(p * p + q * q) / 2) / sinh(pi * sqrt(p * p + q * q)) * sin(p * pi * y) * sin(q * pi * z) / (p * q)
    want = {i: 16 / pi**2 * sum(term(p, q, (i % 9 + 1) / 10, (s % 9 + 1) / 10) for p in odd for q in odd) for i, s in tables[3]}
    rows = got(spark, tables, "face_series")
    assert len(rows) == 79 and all(v == pytest.approx(want[i], abs=2e-5) for i, v in rows)
