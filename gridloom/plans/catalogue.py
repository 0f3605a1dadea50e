"""Queries over the driver's tables, each with the SQL that checks it. Values are integers where sums are compared."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate, bodies, dataflow, fields, graph, linalg, scan, stencil
from .chain import chain

N, QUERIES, SQL = 200, {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.expr("o_orderkey div 100").alias("r"), (F.col("o_orderkey") % 100).alias("c"), (F.floor("o_totalprice").cast("long") % 100).alias("v"))


def coo(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % N).alias("row"), (F.col("l_partkey") % N).alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("val"))


def vec(spark: SparkSession, n: int = N) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("v"))


GRID = "grid AS (SELECT o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(floor(o_totalprice) AS BIGINT) % 100 AS v FROM orders)"
COO = f"coo AS (SELECT l_orderkey % {N} AS row, l_partkey % {N} AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"
VEC = f"vec AS (SELECT range AS i, range % 7 + 1 AS v FROM range({N}))"
THRESH = "h AS (SELECT v, count(*) AS n FROM grid GROUP BY v), k AS (SELECT v, coalesce(sum(n) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM h), th AS (SELECT min(v) AS t FROM k WHERE b <= t * {p} // 100)"


@query(f"WITH {GRID}, {THRESH.format(p=10)} SELECT r, c, v >= th.t AS keep FROM grid, th")
def thresh_mask(spark, d):
    return scan.threshold_mask(grid(spark, d), 10)


WINNOW = "o AS (SELECT r, c, row_number() OVER (ORDER BY v, r, c) - 1 AS k, count(*) OVER () // {n} AS s FROM grid, th WHERE v >= th.t), pts AS (SELECT k // s AS i, r, c FROM o WHERE k % s = 0 AND k // s < {n})"


@query(f"WITH {GRID}, {THRESH.format(p=10)}, {WINNOW.format(n=50)} SELECT i, r, c FROM pts")
def winnow_points(spark, d):
    g = grid(spark, d)
    return scan.winnow(g, scan.threshold_mask(g, 10), 50)


@query(f"WITH {GRID}, h AS (SELECT v * 17 // 100 AS bin, count(*) AS n FROM grid GROUP BY 1) SELECT range AS bin, coalesce(n, 0) AS n FROM range(17) LEFT JOIN h ON bin = range")
def hist17(spark, d):
    return aggregate.binned_histogram(grid(spark, d), F.col("v"), 17, 100)


@query(f"WITH {GRID} SELECT v AS bin, count(*) AS n FROM grid GROUP BY v")
def exact_hist(spark, d):
    return aggregate.exact_histogram(grid(spark, d), "v")


@query(f"WITH {GRID}, h AS (SELECT v AS bin, count(*) AS n FROM grid GROUP BY v) SELECT bin, n, repeat('#', CAST(n * 60 // max(n) OVER () AS INTEGER)) AS bar, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running FROM h")
def hist_render(spark, d):
    return aggregate.render_histogram(aggregate.exact_histogram(grid(spark, d), "v"))


SHIFTS = "s AS (SELECT r, c, 0 - 4 * v + 20 * v AS v FROM grid UNION ALL SELECT r + 1, c, v FROM grid UNION ALL SELECT r - 1, c, v FROM grid UNION ALL SELECT r, c + 1, v FROM grid UNION ALL SELECT r, c - 1, v FROM grid)"


@query(f"WITH {GRID}, {SHIFTS} SELECT r, c, CAST(sum(s.v) AS BIGINT) AS v FROM s JOIN grid USING (r, c) GROUP BY r, c")
def stencil4_int(spark, d):
    return stencil.apply_stencil(grid(spark, d), ["r", "c"], 16)


@query("SELECT l_suppkey % 4 AS pe, l_orderkey % 8 AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2")
def bucket_counts(spark, d):
    return aggregate.bucket_counts(read(spark, d, "lineitem"), F.col("l_suppkey") % 4, F.col("l_orderkey") % 8)


@query("SELECT event_type, count(*) AS n, min(value) AS min_v, max(value) AS max_v, CAST(round(avg(CAST(floor(value * 100) AS BIGINT)), 6) AS DOUBLE) AS avg_v FROM events GROUP BY 1")
def call_stats(spark, d):
    e = read(spark, d, "events").withColumn("k", F.floor(F.col("value") * 100).cast("long"))
    s = aggregate.call_statistics(e, ["event_type"], "k").select("event_type", F.round("avg_v", 6).cast("double").alias("avg_v"))
    return aggregate.call_statistics(e, ["event_type"], "value").drop("avg_v").join(s, "event_type")


@query("SELECT user_id, min(value) AS min_v, list_sort(list(value))[count(*) // 2 + 1] AS median_v, max(value) AS max_v FROM events GROUP BY 1")
def upper_median(spark, d):
    return aggregate.repeat_statistics(read(spark, d, "events"), ["user_id"], "value")


PTS = "pts AS (SELECT vec_id AS i, CAST(round(embedding[1] * 1000) AS BIGINT) AS x, CAST(round(embedding[2] * 1000) AS BIGINT) AS y FROM embeddings WHERE vec_id < 40)"


@query(f"WITH {PTS} SELECT a.i, CAST(40 * max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS BIGINT) AS d FROM pts a, pts b GROUP BY a.i")
def outer_diag(spark, d, some="vec_id < 40"):
    e = F.col("embedding")
    pts = read(spark, d, "embeddings").filter(some).select(F.col("vec_id").alias("i"), F.round(e[0].cast("double") * 1000).cast("long").alias("x"), F.round(e[1].cast("double") * 1000).cast("long").alias("y"))
    return linalg.farthest(pts, ["x", "y"], squared=True)


@query(f"WITH {COO}, {VEC} SELECT row AS i, CAST(sum(val * v) AS BIGINT) AS v FROM coo JOIN vec ON col = i GROUP BY row")
def spmv_int(spark, d):
    return linalg.spmv(coo(spark, d), vec(spark))


@query(f"WITH {GRID}, g AS (SELECT r, c, v FROM grid WHERE r < 100), p AS (SELECT a.v, b.v AS w FROM g a JOIN g b ON a.r = b.c AND a.c = b.r WHERE a.r < a.c) SELECT max(abs(v - w)) AS max_diff, CAST(sum(abs(v - w)) AS BIGINT) AS total_diff FROM p")
def sym_diff(spark, d):
    return aggregate.symmetry_error(grid(spark, d).filter("r < 100")).select("max_diff", "total_diff")


@query(f"WITH {GRID} SELECT r, c, CAST(sum(v) OVER (PARTITION BY r ORDER BY c) AS BIGINT) AS running FROM grid")
def prefix_sum(spark, d):
    return scan.prefix_sum(grid(spark, d), ["r"], ["c"], "v").select("r", "c", "running")


@query(f"WITH {GRID}, m AS (SELECT min(v) AS a, max(v) AS b FROM grid) SELECT a AS min_v, min(CASE WHEN v = a THEN r * 100 + c END) AS min_at, b AS max_v, min(CASE WHEN v = b THEN r * 100 + c END) AS max_at FROM grid, m GROUP BY a, b")
def global_minmax(spark, d):
    x = aggregate.min_max_with_location(grid(spark, d), "v", "r", "c")
    return x.select("min_v", (F.col("at_min.r") * 100 + F.col("at_min.c")).alias("min_at"), "max_v", (F.col("at_max.r") * 100 + F.col("at_max.c")).alias("max_at"))


def two(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("i"), (F.floor("o_totalprice").cast("long") % 1000).alias("v")), o.select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 1000).alias("v"))


TWO = "x AS (SELECT o_orderkey AS i, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS v, o_custkey % 1000 AS w FROM orders)"


@query(f"WITH {TWO} SELECT CAST(sum(v * w) AS BIGINT) AS dot FROM x")
def dot(spark, d):
    return aggregate.dot(*two(spark, d))


@query(f"WITH {TWO} SELECT CAST(sum(v * v) AS BIGINT) AS sq_norm FROM x")
def sq_norm(spark, d):
    return aggregate.squared_norm(two(spark, d)[0])


@query(f"WITH {TWO} SELECT i, 2 * v + 3 * w AS v FROM x")
def waxpby_int(spark, d):
    x, y = two(spark, d)
    return linalg.waxpby(2, x, 3, y)


@query(f"WITH {TWO} SELECT max(abs(v - w)) AS max_abs_diff FROM x")
def max_abs_diff(spark, d):
    return aggregate.max_abs_diff(*two(spark, d))


@query(f"WITH {GRID} SELECT count(*) AS n FROM grid WHERE v = 42")
def marker_count(spark, d):
    return grid(spark, d).filter("v = 42").agg(F.count("*").alias("n"))


KEYS = "keys AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 4096 AS k FROM lineitem)"


def keys(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 4096).alias("k"))


@query(f"WITH {GRID} SELECT r, c, v, row_number() OVER (ORDER BY v, r, c) - 1 AS rank FROM grid")
def sort_rank(spark, d):
    return scan.global_rank(grid(spark, d), F.col("v"), F.col("r"), F.col("c"))


@query(f"WITH {KEYS} SELECT k // 512 AS bucket, count(*) AS n, 1 AS in_range, count(DISTINCT k) AS distinct_keys FROM keys GROUP BY 1")
def sort_verify(spark, d):
    return scan.verify_buckets(scan.bucket_sort(keys(spark, d), "k", 8, 4096), "k", 8, 4096)


@query(f"WITH {KEYS} SELECT k // 512 AS bucket, k, count(*) AS n FROM keys GROUP BY 1, 2")
def counting_sort(spark, d):
    return scan.counting_sort(scan.bucket_sort(keys(spark, d), "k", 8, 4096), "k")


@query(f"WITH {TWO}, s AS (SELECT i, v, sum(v) OVER (ORDER BY i) - v AS b, sum(v) OVER () AS t FROM x) SELECT i, CAST(least(b * 8 // t, 7) AS BIGINT) AS zone FROM s")
def cost_partition(spark, d):
    return scan.cost_zones(two(spark, d)[0], "i", "v", 8).select("i", "zone")


@query("WITH s AS (SELECT l_suppkey AS p, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT min(n) AS min_v, max(n) AS max_v, avg(n) AS m, stddev_samp(n) AS s, arg_min(p, n * 1000000 + p) AS min_proc, arg_max(p, n * 1000000 + p) AS max_proc, CAST(sum(n) AS BIGINT) AS sum_v FROM s) SELECT min_v, min_proc, max_v, max_proc, sum_v, round(m, 6) AS avg_v, round(greatest(abs(min_v - m), abs(max_v - m)) / m * 100, 6) AS imbalance_pct, round(s / m * 100, 6) AS stddev_pct FROM a")
def imbalance(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("p")).agg(F.count("*").alias("n"))
    x = aggregate.spread(s, "p", "n")
    return x.select("min_v", "min_proc", "max_v", "max_proc", "sum_v", *(F.round(c, 6).alias(c) for c in ("avg_v", "imbalance_pct", "stddev_pct")))


@query("SELECT l_suppkey, min(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS min_v FROM lineitem GROUP BY 1")
def region_min(spark, d):
    return aggregate.conditional_min(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", F.col("l_returnflag") == "R")


@query(f"WITH {GRID}, {VEC} SELECT r AS i, CAST(sum(grid.v * vec.v) AS BIGINT) AS v FROM grid JOIN vec ON c = i GROUP BY r")
def mat_vec(spark, d):
    return linalg.mat_vec(grid(spark, d).select(F.col("r").alias("i"), F.col("c").alias("j"), F.col("v").alias("d")), vec(spark))


@query("SELECT l_partkey AS node, CAST(sum(o_custkey) AS BIGINT) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def scatter_add(spark, d):
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("node"))
    return linalg.scatter_add(b, read(spark, d, "orders").select(F.col("o_orderkey").alias("elem"), F.col("o_custkey").alias("x")), "elem", "node", "x")


@query("SELECT l_orderkey AS elem, array_to_string(list(p_size ORDER BY l_linenumber, l_partkey, p_size), ',') AS corners FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def gather_corners(spark, d):
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_linenumber").alias("corner"), F.col("l_partkey").alias("node"))
    g = linalg.gather(b, read(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size"), "elem", "node", "corner", "p_size")
    return g.select("elem", F.array_join(F.transform("corners", lambda x: x.cast("string")), ",").alias("corners"))


@query(f"WITH {COO} SELECT row, col, val FROM coo WHERE row % 10 <> 0 AND col % 10 <> 0 UNION ALL SELECT range * 10, range * 10, 1 FROM range({N // 10})")
def dirichlet(spark, d):
    b = spark.range(0, N, 10).withColumnRenamed("id", "i")
    return linalg.dirichlet(coo(spark, d), vec(spark), b, 1)[0]


@query(f"WITH {COO}, {VEC}, m AS (SELECT row, sum(val) AS m FROM coo WHERE row % 10 <> 0 AND col % 10 = 0 GROUP BY row) SELECT i, CAST(CASE WHEN i % 10 = 0 THEN 1 ELSE v - coalesce(m, 0) END AS BIGINT) AS v FROM vec LEFT JOIN m ON row = i")
def dirichlet_rhs(spark, d):
    b = spark.range(0, N, 10).withColumnRenamed("id", "i")
    return linalg.dirichlet(coo(spark, d), vec(spark), b, 1)[1].select("i", F.col("v").cast("long").alias("v"))


@query(f"WITH {COO} SELECT DISTINCT row // 25 AS owner, col, col // 25 AS col_owner FROM coo WHERE row // 25 <> col // 25")
def externals(spark, d):
    return linalg.externals(coo(spark, d), 25)


@query(f"WITH {GRID} SELECT r // 2 AS r, c // 2 AS c, v * 4 AS v FROM grid WHERE r % 2 = 1 AND c % 2 = 1")
def restrict_inject(spark, d):
    return stencil.restrict(grid(spark, d), ["r", "c"])


@query(f"WITH {GRID}, o AS (SELECT a.range - 1 AS i, b.range - 1 AS j FROM range(3) a, range(3) b) SELECT 2 * r + 1 - i AS r, 2 * c + 1 - j AS c, CAST(sum(v * (64 // (2 ** (abs(i) + abs(j)))::BIGINT)) AS BIGINT) AS v FROM grid, o WHERE r < 30 GROUP BY 1, 2")
def prolong_int(spark, d, some="r < 30"):
    return stencil.prolong(grid(spark, d).filter(some), ["r", "c"], 64)


def _heat_sql() -> str:
    parts = [GRID, "g0 AS (SELECT r, c, v FROM grid WHERE r < 10)"]
    for k in range(3):
        moves = " UNION ALL ".join(f"SELECT (r + {i} + 10) % 10 AS r, (c + {j} + 100) % 100 AS c, v FROM g{k}" for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        parts.append(f"g{k + 1} AS (SELECT r, c, CAST(sum(v) AS BIGINT) AS v FROM (SELECT r, c, 16 * v AS v FROM g{k} UNION ALL {moves}) GROUP BY r, c)")
    return f"WITH {', '.join(parts)} SELECT r, c, v FROM g3"


@query(_heat_sql())
def heat_k_steps(spark, d, rows=10):
    g = grid(spark, d).filter(F.col("r") < rows)
    for _ in range(3):
        g = stencil.apply_stencil(g, ["r", "c"], 16, [rows, 100])
    return g


@query(f"WITH RECURSIVE {GRID}, w AS (SELECT r * 100 + c AS id, r, c FROM grid WHERE v >= 80 AND r < 30 AND c < 30), e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON abs(a.r - b.r) + abs(a.c - b.c) = 1), reach(x, y) AS (SELECT id, id FROM w UNION SELECT x, b FROM reach JOIN e ON y = a), l AS (SELECT x, min(y) AS label FROM reach GROUP BY x) SELECT label, count(*) AS n FROM l GROUP BY label")
def components(spark, d, some="r < 30 AND c < 30"):
    cells = grid(spark, d).filter("v >= 80").filter(some).select((F.col("r") * 100 + F.col("c")).alias("id"), "r", "c")
    return graph.components(cells, graph.grid_links(cells)).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 50 AS a, o_orderkey % 60 + 100 AS b FROM orders WHERE o_orderkey % 7 = 0), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(x, k) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT b, k + 1 FROM reach JOIN f ON x = a WHERE k < 4) SELECT x AS state, min(k) AS cost FROM reach GROUP BY x")
def bfs_levels(spark, d, some="o_orderkey % 7 = 0", depth=4):
    o = read(spark, d, "orders").filter(some).select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 60 + 100).alias("b")).distinct()
    e = o.unionByName(o.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start, expand = spark.range(1).withColumnRenamed("id", "state"), lambda f: f.join(e, F.col("state") == F.col("a")).select(F.col("b").alias("state"))
    if depth is None:
        return graph.explore(start, expand)
    return graph.explore(start, expand, most=depth + 1).filter(F.col("cost") <= depth)


@query("WITH RECURSIVE a AS (SELECT DISTINCT o_custkey % 40 AS tail, o_custkey % 40 + 1 + o_orderkey % 9 AS head FROM orders WHERE o_orderkey % 5 = 0), n AS (SELECT tail AS id FROM a UNION SELECT head FROM a), p(id, k) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT head FROM a) UNION SELECT head, k + 1 FROM p JOIN a ON id = tail) SELECT id, max(k) AS level FROM p GROUP BY id")
def dag_levels(spark, d, some="o_orderkey % 5 = 0"):
    a = read(spark, d, "orders").filter(some).select((F.col("o_custkey") % 40).alias("tail"), (F.col("o_custkey") % 40 + 1 + F.col("o_orderkey") % 9).alias("head")).distinct()
    return graph.levels(a.select(F.col("tail").alias("id")).union(a.select("head")).distinct(), a)


@query("WITH s AS (SELECT user_id % 20 AS problem, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT *, n / min(n) OVER (PARTITION BY problem) AS x FROM s) SELECT event_type, round(avg(x), 6) AS rank FROM b GROUP BY 1")
def rank_vs_min(spark, d):
    s = read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("problem"), "event_type").agg(F.count("*").alias("n"))
    return aggregate.rank_against_best(s, "problem", "event_type", "n").select("event_type", F.round("rank", 6).alias("rank"))


@query("WITH m AS (SELECT l_returnflag AS lang, l_linenumber AS threads, avg(CAST(l_quantity AS BIGINT)) AS m FROM lineitem GROUP BY 1, 2) SELECT lang, threads, round(max(CASE WHEN threads = 1 THEN m END) OVER (PARTITION BY lang) / m, 6) AS speed_up FROM m")
def speedup(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("lang"), F.col("l_linenumber").alias("threads"), F.col("l_quantity").cast("long").alias("t"))
    return aggregate.speed_up(x, ["lang"], "threads", "t").withColumn("speed_up", F.round("speed_up", 6))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("WITH u AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT count(*) AS n_all, count(DISTINCT k) AS n_distinct FROM u")
def union_dedup(spark, d):
    u = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey"))
    return u.agg(F.count("*").alias("n_all"), F.countDistinct("k").alias("n_distinct"))


@query(f"WITH {TWO} SELECT i, CASE WHEN v < 100 THEN 0 WHEN abs(v - 500) < 5 THEN 500 ELSE least(v, 900) END AS v FROM x")
def clamp_snap(spark, d):
    from ..functions import clamp, snap

    x = two(spark, d)[0]
    return x.select("i", F.when(F.col("v") < 100, F.lit(0)).otherwise(clamp(snap(F.col("v"), 500, 5), high=900)).cast("long").alias("v"))


CHAIN = f"WITH {GRID}, {THRESH.format(p=10)}, {WINNOW.format(n=50)}, dist AS (SELECT a.i, b.i AS j, sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM pts a, pts b), m AS (SELECT i, 50 * max(d) AS m FROM dist GROUP BY i) SELECT dist.i, round(sum(CASE WHEN dist.i = j THEN m ELSE d END * sqrt(p.r * p.r + p.c * p.c)), 4) AS v FROM dist JOIN m ON m.i = dist.i JOIN pts p ON p.i = j GROUP BY dist.i"


@query(CHAIN)
def chain_grid(spark, d):
    return chain(grid(spark, d), 10, 50).select("i", F.round("v", 4).alias("v"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, min(value) AS min_v, max(value) AS max_v FROM events GROUP BY 1, 2")
def stream_call_stats(spark, d):
    from ..streaming import stream_statistics

    return stream_statistics(spark, f"{d}/events.parquet", read(spark, d, "events").schema).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def places(spark, d):
    m = F.col("l_linenumber").cast("double")
    return read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), m.alias("mass"), (F.col("l_partkey") % 64).cast("double").alias("x"), (F.col("l_suppkey") % 64).cast("double").alias("y"), F.col("l_quantity").alias("z"), (F.col("l_partkey") % 7).cast("double").alias("vx"), (F.col("l_orderkey") % 5).cast("double").alias("vy"), m.alias("vz"), F.col("l_quantity").alias("phi"))


PLACES = "places AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber AS BIGINT) AS mass, l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(l_quantity AS BIGINT) AS z, l_partkey % 7 AS vx, l_orderkey % 5 AS vy, l_linenumber AS vz, CAST(l_quantity AS BIGINT) AS phi FROM lineitem)"
PATHS = f"{PLACES}, paths AS (SELECT *, concat({', '.join(f'(x // {k} % 2) * 4 + (y // {k} % 2) * 2 + z // {k} % 2' for k in (32, 16, 8, 4, 2, 1))}) AS path FROM places), cells AS (SELECT *, t.range AS d, substr(path, 1, t.range) AS cell FROM paths, range({{n}}) t)"


@query(f"WITH {PATHS.format(n=4)} SELECT cell, count(*) AS n, CAST(sum(mass) AS DOUBLE) AS mass, round(sum(mass * x) / sum(mass), 6) AS x, round(sum(mass * y) / sum(mass), 6) AS y, round(sum(mass * z) / sum(mass), 6) AS z FROM cells GROUP BY cell")
def octree_masses(spark, d):
    return bodies.cell_masses(places(spark, d), 0.0, 64.0, 3).select("cell", "n", "mass", *(F.round(a, 6).alias(a) for a in bodies.AXES))


@query(f"WITH {PATHS.format(n=7)}, light AS (SELECT cell FROM cells GROUP BY cell HAVING count(*) <= 10), f AS (SELECT path, arg_min(cell, d) AS leaf FROM cells JOIN light USING (cell) GROUP BY path) SELECT coalesce(leaf, path) AS leaf, count(*) AS n FROM paths LEFT JOIN f USING (path) GROUP BY 1")
def octree_leaves(spark, d):
    return bodies.octree_leaves(places(spark, d), 0.0, 64.0, 6).groupBy("leaf").agg(F.count("*").alias("n"))


@query(f"WITH {PLACES} SELECT CAST(sum(mass) AS DOUBLE) AS mass, sum(mass * (vx * vx + vy * vy + vz * vz)) / 2 AS kinetic, sum(mass * phi) / 2 AS potential, round(sum(mass * x) / sum(mass), 6) AS mean_x, round(sum(mass * vz) / sum(mass), 6) AS mean_vz, CAST(sum(mass * (y * vz - z * vy)) AS DOUBLE) AS spin_x, CAST(sum(mass * (z * vx - x * vz)) AS DOUBLE) AS spin_y, CAST(sum(mass * (x * vy - y * vx)) AS DOUBLE) AS spin_z FROM places")
def body_diagnostics(spark, d):
    x = bodies.diagnostics(places(spark, d))
    return x.select("mass", "kinetic", "potential", F.round("mean_x", 6).alias("mean_x"), F.round("mean_vz", 6).alias("mean_vz"), "spin_x", "spin_y", "spin_z")


@query("WITH b AS (SELECT vec_id AS id, CAST(label % 5 + 1 AS DOUBLE) AS m, CAST(round(embedding[1] * 1000) AS BIGINT) / 100 AS x, CAST(round(embedding[2] * 1000) AS BIGINT) / 100 AS y, CAST(round(embedding[3] * 1000) AS BIGINT) / 100 AS z FROM embeddings WHERE vec_id < 40), p AS (SELECT a.id, b.m, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) + 0.25 AS s FROM b a JOIN b ON a.id <> b.id) SELECT id, round(-sum(m / sqrt(s)), 5) AS phi, round(sum(m / sqrt(s) / s * x), 5) AS ax, round(sum(m / sqrt(s) / s * y), 5) AS ay, round(sum(m / sqrt(s) / s * z), 5) AS az FROM p GROUP BY id")
def gravity_pairs(spark, d, some="vec_id < 40"):
    e = F.col("embedding")
    b = read(spark, d, "embeddings").filter(some).select(F.col("vec_id").alias("id"), (F.col("label") % 5 + 1).cast("double").alias("mass"), *((F.round(e[k].cast("double") * 1000).cast("long") / 100).alias(a) for k, a in enumerate(bodies.AXES)))
    return bodies.gravity(b, 0.5).select("id", *(F.round(c, 5).alias(c) for c in ("phi", "ax", "ay", "az")))


CUBE = "cube AS (SELECT o_orderkey // 100 AS z, o_orderkey // 10 % 10 AS y, o_orderkey % 10 AS x, CAST(floor(o_totalprice) AS BIGINT) % 100 AS v FROM orders WHERE o_orderkey < 1000)"


def cube(spark, d, some="o_orderkey < 1000"):
    v = (F.floor("o_totalprice").cast("long") % 100).cast("double")
    return read(spark, d, "orders").filter(some).select(F.expr("o_orderkey div 100").alias("z"), F.expr("o_orderkey div 10 % 10").alias("y"), (F.col("o_orderkey") % 10).alias("x"), v.alias("re"), F.lit(0.0).alias("im"))


@query(f"WITH {CUBE} SELECT CAST(sum(v) AS BIGINT) / 1000 AS re, 0.0::DOUBLE AS im FROM range(1, 1025) j JOIN cube ON z = j.range * 5 % 10 AND y = j.range * 3 % 10 AND x = j.range % 10")
def strided_checksum(spark, d):
    return fields.strided_checksum(cube(spark, d), 10, 10, 10)


@query(f"WITH {CUBE}, c AS (SELECT z, y, x, v FROM cube WHERE z < 4 AND y < 4 AND x < 4 AND v IS NOT NULL), t AS (SELECT a.range AS z, b.range AS y, e.range AS x, v, pi() / 2 * (a.range * z + b.range * y + e.range * x) AS w FROM range(4) a, range(4) b, range(4) e, c) SELECT z, y, x, round(sum(v * cos(w)), 4) + 0 AS re, round(-sum(v * sin(w)), 4) + 0 AS im FROM t GROUP BY 1, 2, 3")
def fourier_cube(spark, d):
    return _fourier(spark, cube(spark, d), 4, 4)


def _fourier(spark, cells, nz, n):
    """Transform of the nz x n x n cube; cells that are missing count as 0."""
    whole = spark.range(nz * n * n).select(F.expr(f"id div {n * n}").alias("z"), F.expr(f"id div {n} % {n}").alias("y"), (F.col("id") % n).alias("x"))
    part = whole.join(cells, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    return fields.fft3(part).select("z", "y", "x", *((F.round(c, 4) + 0).alias(c) for c in ("re", "im")))


@query(f"WITH {GRID}, s AS (SELECT r, c, 2 * v - 4 * v AS v FROM grid UNION ALL SELECT r + 1, c, v FROM grid UNION ALL SELECT r - 1, c, v FROM grid UNION ALL SELECT r, c + 1, v FROM grid UNION ALL SELECT r, c - 1, v FROM grid) SELECT r, c, CAST(sum(s.v) AS DOUBLE) AS v FROM s JOIN grid USING (r, c) GROUP BY r, c")
def grid_residual(spark, d):
    g = grid(spark, d).withColumn("v", F.col("v").cast("double"))
    return fields.residual(g, g.withColumn("v", F.col("v") * 2), ["r", "c"])


@query("WITH k AS (SELECT a.range * 2 + 1 AS p, b.range * 2 + 1 AS q FROM range(12) a, range(12) b), t AS (SELECT p_partkey AS i, 0.5 AS x, (p_partkey % 9 + 1) / 10 AS y, (p_size % 9 + 1) / 10 AS z FROM part WHERE p_partkey <= 50) SELECT i, round(16 / pow(pi(), 2) * sum(sinh(pi() * sqrt(p * p + q * q) * x) / sinh(pi() * sqrt(p * p + q * q)) * sin(p * pi() * y) * sin(q * pi() * z) / (p * q)), 5) AS v FROM t, k GROUP BY i")
def face_series(spark, d, some="p_partkey <= 50"):
    pts = read(spark, d, "part").filter(some).select(F.col("p_partkey").alias("i"), F.lit(0.5).alias("x"), ((F.col("p_partkey") % 9 + 1) / 10).alias("y"), ((F.col("p_size") % 9 + 1) / 10).alias("z"))
    return fields.face_series(pts, 12).select("i", F.round("v", 5).alias("v"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS e, CAST(l_quantity AS BIGINT) - 25 AS k, l_linenumber AS v FROM lineitem), p AS (SELECT *, CASE WHEN v >= 7 THEN 0 ELSE greatest((k + 1) * e * 2 / 3, 0) END AS p FROM s) SELECT l_orderkey, l_linenumber, round(p, 4) AS p, CASE WHEN e * 2 / 3 + v * v * (k + 1) * 2 / 3 * p <= 1.111111e-37 THEN 0.0 ELSE round(sqrt(e * 2 / 3 + v * v * (k + 1) * 2 / 3 * p), 4) END AS speed FROM p")
def state_equation(spark, d):
    s = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice").cast("long") % 1000).alias("e"), (F.col("l_quantity").cast("long") - 25).alias("k"), F.col("l_linenumber").alias("v"))
    p = s.withColumn("p", fields.pressure(F.col("e"), F.col("k"), F.col("v"), most=7))
    return p.select("l_orderkey", "l_linenumber", F.round("p", 4).alias("p"), F.round(fields.sound_speed(F.col("e"), F.col("k"), F.col("p"), F.col("v")), 4).alias("speed"))


@query(f"WITH {TWO} SELECT i, greatest(least((v - 300 + w - 300) / 2, (v - 300) * 2.0::DOUBLE, (w - 300) * 2.0::DOUBLE, 500.0::DOUBLE), 0) AS slope FROM x")
def slope_limit(spark, d):
    x, y = two(spark, d)
    both = x.join(y.select("i", F.col("v").alias("w")), "i")
    return both.select("i", fields.slope_limiter(F.col("v") - 300, F.col("w") - 300, 500.0).alias("slope"))


@query("WITH s AS (SELECT o_orderpriority AS k, o_custkey % 50 - o_orderkey % 47 AS d FROM orders), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2 AS r FROM s WHERE d <> 0), w AS (SELECT k, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY k) SELECT k, n, w_plus, w_minus, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM s JOIN w USING (k) GROUP BY k, n, w_plus, w_minus")
def signed_ranks(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 47).alias("b"))
    return fields.signed_ranks(o, ["k"], "a", "b").withColumn("t", F.round("t", 6))


def dataflow_checksums(spark, d):
    """No SQL: streams depend on the sample before; tests hold the published checksums."""
    parts = [dataflow.checksum(spark, kind).select(F.lit(kind).alias("kind"), "total") for kind in ("BH", "WH", "SH")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["dataflow_checksums"] = dataflow_checksums


# The queries above whose SQL reads a part of its table, over the whole of it. No SQL; tests hold them against brute force.
def layers(df: DataFrame, axis: str) -> int:
    """Length of an axis that starts at 0."""
    return (df.agg(F.max(axis)).first()[0] or 0) + 1


for _name, _f in {"outer_diag": outer_diag, "prolong_int": prolong_int, "components": components, "dag_levels": dag_levels, "gravity_pairs": gravity_pairs, "face_series": face_series}.items():
    QUERIES[f"whole_{_name}"] = partial(_f, some="true")
QUERIES["whole_bfs_levels"] = partial(bfs_levels, some="true", depth=None)


def whole_heat_k_steps(spark, d):
    return heat_k_steps(spark, d, layers(grid(spark, d), "r"))


def whole_strided_checksum(spark, d):
    cells = cube(spark, d, "true")
    return fields.strided_checksum(cells, 10, 10, layers(cells, "z"))


def whole_fourier_cube(spark, d):
    cells = cube(spark, d, "true")
    return _fourier(spark, cells, layers(cells, "z"), 10)


QUERIES |= {f.__name__: f for f in (whole_heat_k_steps, whole_strided_checksum, whole_fourier_cube)}
