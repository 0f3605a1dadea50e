"""Point masses: softened gravity, octree cells, leapfrog steps and conserved quantities. Bodies: id, mass, x, y, z, vx, vy, vz."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import octant_path

AXES = ("x", "y", "z")


def gravity(bodies: DataFrame, eps: float = 0.05) -> DataFrame:
    """(id, phi, ax, ay, az) from all other bodies, with distances softened by eps. The operator is the product itself."""
    other = bodies.select(F.col("id").alias("_id"), F.col("mass").alias("_m"), *(F.col(a).alias(f"_{a}") for a in AXES))
    pairs = bodies.select("id", *AXES).crossJoin(other).filter("id <> _id")
    square = sum(((F.col(f"_{a}") - F.col(a)) ** 2 for a in AXES), F.lit(eps * eps))
    pairs = pairs.withColumn("_s", square).withColumn("_p", F.col("_m") / F.sqrt("_s"))
    pulls = (F.sum(F.col("_p") / F.col("_s") * (F.col(f"_{a}") - F.col(a))).alias(f"a{a}") for a in AXES)
    return pairs.groupBy("id").agg((-F.sum("_p")).alias("phi"), *pulls)


def leapfrog(bodies: DataFrame, dt: float, eps: float = 0.05) -> DataFrame:
    """Half a kick, a drift, half a kick."""
    kick = lambda b: b.join(gravity(b, eps), "id", "left").select("id", "mass", *AXES, *((F.col(f"v{a}") + dt / 2 * F.coalesce(f"a{a}", F.lit(0.0))).alias(f"v{a}") for a in AXES))
    moved = kick(bodies).select("id", "mass", *((F.col(a) + dt * F.col(f"v{a}")).alias(a) for a in AXES), *(f"v{a}" for a in AXES))
    return kick(moved)


def octree_leaves(bodies: DataFrame, low: float, size: float, levels: int = 16, most: int = 10) -> DataFrame:
    """(id, leaf): the shortest octant path that at most ``most`` bodies share; bodies that no level tells apart share the deepest."""
    located = bodies.select("id", octant_path(F.col("x"), F.col("y"), F.col("z"), low, size, levels).alias("path"))
    prefixes = located.select("path", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("depth")).select(F.expr("substring(path, 1, depth)").alias("cell"))
    light = prefixes.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("cell")
    candidates = located.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("depth")).select("path", F.expr("substring(path, 1, depth)").alias("cell"))
    found = candidates.join(light, "cell").groupBy("path").agg(F.min_by("cell", F.length("cell")).alias("leaf"))
    return located.join(found, "path", "left").select("id", F.coalesce("leaf", "path").alias("leaf"))


def cell_masses(bodies: DataFrame, low: float, size: float, levels: int) -> DataFrame:
    """(cell, n, mass, x, y, z): mass and centre of mass of every octree cell down to ``levels``."""
    path = octant_path(F.col("x"), F.col("y"), F.col("z"), low, size, levels)
    spread = bodies.withColumn("_path", path).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("cell", F.expr("substring(_path, 1, _d)"))
    return spread.groupBy("cell").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), *((F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a) for a in AXES))


def diagnostics(bodies: DataFrame) -> DataFrame:
    """One row: mass, kinetic and potential energy (phi), centre of mass and its velocity, angular momentum."""
    m, speed = F.col("mass"), sum((F.col(f"v{a}") ** 2 for a in AXES), F.lit(0.0))
    turn = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    return bodies.agg(
        F.sum(m).alias("mass"),
        F.sum(m * speed / 2).alias("kinetic"),
        F.sum(m * F.col("phi") / 2).alias("potential"),
        *((F.sum(m * F.col(c)) / F.sum(m)).alias(f"mean_{c}") for a in AXES for c in (a, f"v{a}")),
        *(F.sum(m * (F.col(p) * F.col(f"v{q}") - F.col(q) * F.col(f"v{p}"))).alias(f"spin_{a}") for a, (p, q) in turn.items()),
    )


def plummer(spark: SparkSession, n: int, seed: int = 123, offset: float = 4.0) -> DataFrame:
    """A Plummer sphere of n equal masses; the second half is the first, moved by ``offset``; centred on its mean.

    Each body draws from a generator of its own, so partitioning doesn't change it.
    """
    half, scale = (n + 1) // 2, 3 * np.pi / 16

    def direction(g, r):
        v = g.normal(size=3)
        return v / np.linalg.norm(v) * r

    def make(frames):
        for pdf in frames:
            rows = []
            for i in pdf["id"]:
                g = np.random.default_rng([seed, int(i) % half])
                r = 1 / np.sqrt(g.uniform(1e-6, 0.999) ** (-2 / 3) - 1)
                q = g.uniform()
                while g.uniform(0, 0.1) > q * q * (1 - q * q) ** 3.5:
                    q = g.uniform()
                speed = np.sqrt(2) * q / (1 + r * r) ** 0.25
                rows.append([i, 1 / n, *(direction(g, r * scale) + (offset if i >= half else 0)), *direction(g, speed / np.sqrt(scale))])
            yield pd.DataFrame(rows, columns=["id", "mass", *AXES, "vx", "vy", "vz"])

    drawn = spark.range(n).mapInPandas(make, "id long, mass double, x double, y double, z double, vx double, vy double, vz double")
    names = [*AXES, "vx", "vy", "vz"]
    means = drawn.agg(*(F.avg(c).alias(f"_{c}") for c in names))
    return drawn.join(F.broadcast(means)).select("id", "mass", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in names))  # one row
