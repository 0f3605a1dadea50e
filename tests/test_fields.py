"""Dataflow graphs against published checksums; bodies, transforms, elements and statistics against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bodies, dataflow, fields
from gridloom.sources import formats, generators


@pytest.mark.parametrize("kind,want", [("BH", 30892725), ("WH", 67349758), ("SH", 58875767)])
def test_dataflow_checksums(spark, kind, want):
    assert dataflow.checksum(spark, kind, "S").first()["total"] == want


@pytest.mark.parametrize("kind,sources,nodes", [("BH", 8, 11), ("WH", 16, 21), ("SH", 8, 32)])
def test_dataflow_sizes(spark, kind, sources, nodes):
    assert dataflow.build_graph(spark, kind, sources)[0].count() == nodes


def test_fourier(spark):
    a = np.random.default_rng(1).normal(size=(4, 2, 8))
    cube = spark.createDataFrame([(z, y, x, float(a[z, y, x]), 0.0) for z in range(4) for y in range(2) for x in range(8)], fields.CUBE)
    out = {(r.z, r.y, r.x): r.re + 1j * r.im for r in fields.fft3(cube).collect()}
    want = np.fft.fftn(a)
    assert all(abs(out[i] - want[i]) < 1e-9 for i in np.ndindex(want.shape))


def test_elements_follow_the_series(spark):
    n = 6
    nodes, elems = generators.hex_mesh(spark, n, 1.0)
    matrix, _ = fields.assemble(elems, 1.0 / n)
    k = np.zeros(((n + 1) ** 3,) * 2)
    for r in matrix.collect():
        k[r.row, r.col] = r.val
    assert abs(k.sum(axis=1)).max() < 1e-12
    xyz = np.array([(r.x, r.y, r.z) for r in nodes.orderBy("node").collect()])
    edge = (np.isclose(xyz, 0) | np.isclose(xyz, 1)).any(axis=1)
    u = np.where(np.isclose(xyz[:, 0], 1), 1.0, 0.0)
    side = (np.isclose(xyz[:, 1:], 0) | np.isclose(xyz[:, 1:], 1)).any(axis=1)
    u[side] = 0
    u[~edge] = np.linalg.solve(k[np.ix_(~edge, ~edge)], -k[np.ix_(~edge, edge)] @ u[edge])
    middle = spark.createDataFrame([(0, 0.5, 0.5, 0.5)], "i long, x double, y double, z double")
    assert abs(fields.face_series(middle).first()["v"] - 1 / 6) < 1e-3
    assert abs(u[np.isclose(xyz, 0.5).all(axis=1)][0] - 1 / 6) < 0.06


def test_multigrid_cycle_shrinks_the_residual(spark):
    rhs = spark.createDataFrame([(r, c, float(r + 2 * c)) for r in range(3) for c in range(3)], "r long, c long, v double")
    zero = rhs.withColumn("v", F.lit(0.0))
    size = lambda u: fields.residual(u, rhs, ["r", "c"]).agg(F.max(F.abs(F.col("v")))).first()[0]
    assert size(fields.multigrid_cycle(zero, rhs, ["r", "c"], 2)) < 0.2 * size(zero)


def test_substeps_land_on_outputs():
    steps = fields.substeps([0.3, 0.5], 0.5)
    assert [round(s, 6) for s, _ in steps] == [0.125, 0.125, 0.05, 0.125, 0.075] and [o for _, o in steps] == [False, False, True, False, True]


def test_hexahedra(spark):
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    made = spark.createDataFrame([([[float(x * s + z), float(y), float(z)] for x, y, z in cube],) for s in (1, 2)], "c array<array<double>>")
    got = made.withColumn("v", fields.hex_volume(F.col("c"))).withColumn("l", fields.characteristic_length(F.col("c"), F.col("v"))).orderBy("v").collect()
    assert [r.v for r in got] == pytest.approx([1.0, 2.0])
    straight = spark.createDataFrame([([list(map(float, p)) for p in cube],)], "c array<array<double>>")
    assert straight.select(fields.characteristic_length(F.col("c"), fields.hex_volume(F.col("c")))).first()[0] == pytest.approx(1.0)


def test_step_control():
    assert fields.next_step(1e-3, 1, 2.1e-3, 1) == 1e-3  # grows too little
    assert fields.next_step(1e-3, 1, 1, 1) == pytest.approx(1.2e-3)
    assert fields.next_step(1e-3, 1.3e-3, 2e-3, 1) == pytest.approx(2e-3 / 3)
    assert fields.next_step(1e-3, 5e-4, 2e-3, 1) == 5e-4
    assert fields.next_step(1e-3, 1, 2.1e-3, 1.2e-3) == 1e-3  # the whole hydro limit is above half the courant limit
    assert fields.next_step(1e-3, 1, 2.1e-3, 9e-4) == pytest.approx(6e-4)


def test_gravity_and_diagnostics(spark):
    made = bodies.plummer(spark, 12).cache()
    p = made.orderBy("id").toPandas()
    x, m = p[["x", "y", "z"]].to_numpy(), p["mass"].to_numpy()
    d = x[None] - x[:, None]
    s = (d**2).sum(axis=2) + 0.05**2
    w = m[None] / np.sqrt(s) * (1 - np.eye(12))
    got = bodies.gravity(made).orderBy("id").toPandas()
    assert np.allclose(got["phi"], -w.sum(axis=1)) and np.allclose(got[["ax", "ay", "az"]], ((w / s)[..., None] * d).sum(axis=1))
    both = bodies.diagnostics(made.join(bodies.gravity(made), "id")).first()
    assert both["mass"] == pytest.approx(1) and abs(both["mean_vx"]) < 1e-12 and both["potential"] < 0 < both["kinetic"]
    stepped = bodies.diagnostics(bodies.leapfrog(made, 0.01).withColumn("phi", F.lit(0.0))).first()
    assert stepped["spin_z"] == pytest.approx(both["spin_z"], abs=1e-9)


def test_octree(spark):
    points = spark.createDataFrame([(i, 1.0, i / 32, 0.1, 0.1) for i in range(32)] + [(99, 1.0, 0.9, 0.9, 0.9)], "id long, mass double, x double, y double, z double")
    leaves = bodies.octree_leaves(points, 0.0, 1.0, 8).groupBy("leaf").count().collect()
    assert max(r["count"] for r in leaves) <= 10 and {r.leaf: r["count"] for r in leaves}["7"] == 1
    root = bodies.cell_masses(points, 0.0, 1.0, 2).filter("cell = ''").first()
    assert root["mass"] == 33 and root["n"] == 33


def test_statistics(spark):
    assert fields.student_quantiles(10)[9] == pytest.approx(2.228139, abs=1e-4) and fields.student_quantiles(1)[0] == pytest.approx(12.7062, abs=1e-2)
    rows = spark.createDataFrame([("k", float(a), float(b)) for a, b in [(3, 1), (5, 5), (2, 4), (9, 3), (8, 7)]], "k string, a double, b double")
    r = fields.signed_ranks(rows, ["k"], "a", "b").first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (4, 7.5, 2.5)
    low, high = fields.ratio_interval(rows, ["k"], "a", "b").select("low", "high").first()
    assert low < 27 / 20 < high


def test_row_lists_and_bodies(spark, tmp_path):
    (tmp_path / "a").write_text("3\n5\n2\n1\n2\n2 27.0 0 -1.0 2\n1 5.5 1\n2 -1.0 0 27 2\n0 26 1\n0 5.5 1\n0 26 1\n")
    coo, vectors = formats.read_row_lists(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, coo.collect())) == [(0, 0, 27.0), (0, 2, -1.0), (1, 1, 5.5), (2, 0, -1.0), (2, 2, 27.0)]
    assert sorted(map(tuple, vectors.collect())) == [(0, 0.0, 26.0, 1.0), (1, 0.0, 5.5, 1.0), (2, 0.0, 26.0, 1.0)]
    (tmp_path / "b").write_text("2\n3\n0.5\n.25\n.75\n1 2 3\n4 5 6\n7 8 9\n10 11 12\n")
    assert sorted(map(tuple, formats.read_bodies(spark, str(tmp_path / "b")).collect())) == [(0, 0.25, 1, 2, 3, 7, 8, 9), (1, 0.75, 4, 5, 6, 10, 11, 12)]


def test_material_regions(spark):
    r = generators.material_regions(spark, 2, 5000, 4).toPandas()
    assert len(r) == 10000 and set(r["region"]) == {1, 2, 3, 4}


def test_whole_documents(spark, tmp_path):
    (tmp_path / "t").write_text('{\n"scope": "GLOBAL",\n"domains": {"a": {"scope": "NODE", "domains": {"b": {"scope": "CORE"}}}}}\n')
    got = {r.path: (r.parent, r.scope, r.depth) for r in formats.read_json_tree(spark, str(tmp_path / "t")).collect()}
    assert [v[1:] for _, v in sorted(got.items())] == [("GLOBAL", 0), ("NODE", 1), ("CORE", 2)]
    (tmp_path / "r").write_text("Dimensions:\n  nx: 4\n  ny: 5\nTime Summary:\n  Total: 1.5\n")
    assert {(r.section, r.key, r.value) for r in formats.read_report(spark, str(tmp_path / "r")).collect()} == {("Dimensions", "nx", "4"), ("Dimensions", "ny", "5"), ("Time Summary", "Total", "1.5")}
