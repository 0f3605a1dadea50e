"""Frontier search, connected components, levels of a dataflow graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import cut_lineage


def explore(start: DataFrame, expand: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """(state, cost): every state that ``expand`` (frontier -> state) leads to, with its least number of steps; with ``most`` only so many steps."""
    seen = cut_lineage(start.select("state").distinct().withColumn("cost", F.lit(0)))
    frontier, cost = seen, 0
    while most is None or cost < most:
        cost += 1
        frontier = cut_lineage(expand(frontier).select("state").distinct().join(seen, "state", "left_anti").withColumn("cost", F.lit(cost)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if cost % 8 == 0:
            seen = cut_lineage(seen)
    return seen


def puzzle_moves(frontier: DataFrame) -> DataFrame:
    """Successors of 3 x 3 sliding-puzzle states: nine digits, 0 is the blank."""
    at = F.locate("0", F.col("state")) - 1
    moves = [(at >= 3, -3), (at < 6, 3), (at % 3 > 0, -1), (at % 3 < 2, 1)]
    targets = F.filter(F.array(*(F.when(ok, at + d) for ok, d in moves)), lambda x: x.isNotNull())
    spread = frontier.select("state", F.explode(targets).alias("to"))
    tile = F.expr("substring(state, to + 1, 1)")
    # The blank and the tile change places.
    return spread.withColumn("t", tile).select(F.expr("translate(state, concat('0', t), concat(t, '0'))").alias("state"))


def grid_links(cells: DataFrame) -> DataFrame:
    """(a, b): 4-neighbours among the cells (id, r, c)."""
    down = cells.select(F.col("id").alias("a"), (F.col("r") + 1).alias("r"), "c").join(cells.select(F.col("id").alias("b"), "r", "c"), ["r", "c"])
    right = cells.select(F.col("id").alias("a"), "r", (F.col("c") + 1).alias("c")).join(cells.select(F.col("id").alias("b"), "r", "c"), ["r", "c"])
    return down.select("a", "b").unionByName(right.select("a", "b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's component. Labels spread along links and jump to their label's label."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("l"))
        jump = new.select(F.col("id").alias("j"), F.col("l").alias("k"))
        new = cut_lineage(new.join(jump, F.col("l") == F.col("j")).select("id", F.least("l", "k").alias("new"), "label"))
        if not new.filter("new <> label").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", F.col("new").alias("label"))


def levels(nodes: DataFrame, arcs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): the longest path from a source of an acyclic graph (tail, head). A cycle, or a path of ``most`` arcs or more, is an error."""
    # A path of an acyclic graph has fewer arcs than there are nodes.
    limit = nodes.select("id").union(arcs.select("tail")).union(arcs.select("head")).distinct().count() if most is None else most
    out = now = cut_lineage(nodes.join(arcs.select(F.col("head").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("level")))
    k = 0
    while True:
        k += 1
        now = cut_lineage(arcs.join(now, F.col("tail") == F.col("id")).select(F.col("head").alias("id"), F.lit(k).alias("level")).distinct())
        if not now.limit(1).count():
            return out.groupBy("id").agg(F.max("level").alias("level"))
        if k >= limit:
            raise ValueError(f"a path of {k} arcs: the graph has a cycle or is deeper than most")
        out = out.unionByName(now)
        if k % 8 == 0:
            out = cut_lineage(out.groupBy("id").agg(F.max("level").alias("level")))
