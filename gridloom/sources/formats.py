"""Text formats: matrices, points, sparse systems, metrics, reports, logs. All but headers is parsed by SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``nrows ncols``, then a line for each row, then parameter lines: (matrix r, c, v) and the parameters."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    rows = int(lines.orderBy("n").first()["value"].split()[0])
    numbered = lines.orderBy("n").rdd.map(lambda r: r["value"]).zipWithIndex().toDF(["value", "k"])
    cells = numbered.filter((F.col("k") >= 1) & (F.col("k") <= rows)).select((F.col("k") - 1).alias("r"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "v"))
    rest = [r["value"].strip() for r in numbered.filter(F.col("k") > rows).orderBy("k").limit(8).collect()]
    return cells.select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("int").alias("v")), rest


def write_matrix(matrix: DataFrame, path: str, value: str = "v") -> None:
    """A line for each row, in order; the header is a file of its own beside it."""
    rows = matrix.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", value))).alias("x"))
    rows.orderBy("r").select(F.array_join(F.transform("x", lambda s: s[value].cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``n``, then lines ``row col``: (r, c)."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 2)
    return parts.select(F.col("p")[0].cast("long").alias("r"), F.col("p")[1].cast("long").alias("c"))


def write_triples(coo: DataFrame, path: str) -> None:
    """Matlab triples: 1-based row and column, 22 digits wide."""
    coo.orderBy("row", "col").select(F.format_string("%d %d %22.16e", F.col("row") + 1, F.col("col") + 1, "val").alias("value")).write.mode("overwrite").text(path)


def write_mtx(coo: DataFrame, path: str) -> None:
    """``row col coef`` lines behind a header ``rows non-zeros`` in the first file."""
    head = coo.agg(F.format_string("%d %d", F.countDistinct("row"), F.count("*")).alias("value"), F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col"))
    body = coo.select(F.format_string("%d %d %s", "row", "col", F.col("val").cast("string")).alias("value"), "row", "col")
    head.unionByName(body).orderBy("row", "col").select("value").write.mode("overwrite").text(path)


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 3)
    return parts.select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.col("p")[2].cast("double").alias("val"))


def write_vec(vector: DataFrame, path: str) -> None:
    vector.orderBy("i").select(F.concat_ws(" ", "i", "v").alias("value")).write.mode("overwrite").text(path)


def read_vec(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") == 2)
    return parts.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("double").alias("v"))


def write_snapshot(grid: DataFrame, path: str, h: float = 1.0) -> None:
    """Grid (z, y, x, v) as ordered CSV with a header."""
    named = grid.select(F.col("z").alias("z-index"), F.col("y").alias("y-index"), F.col("x").alias("x-index"), (F.col("z") * h).alias("z-coord"), (F.col("y") * h).alias("y-coord"), (F.col("x") * h).alias("x-coord"), F.col("v").alias("heat"))
    named.orderBy("z-index", "y-index", "x-index").write.mode("overwrite").csv(path, header=True)


def write_metrics(stats: DataFrame, path: str) -> None:
    stats.select("tag", "function_name", "par", "elements", "flops", "num_calls", "avg", "min", "max").write.mode("overwrite").csv(path, sep=";", header=True)


def append_measurements(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Comma- or tab-separated timing rows, behind those that are there."""
    rows.write.mode("append").csv(path, sep=sep)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """YAML reports of ``section: / key: value`` lines: (file, variant, section, key, value)."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    top = F.when(F.col("line").rlike(r"^\S[^:]*:\s*$"), F.regexp_extract("line", r"^(\S[^:]*):", 1))
    from pyspark.sql import Window

    section = F.last(top, ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    out = lines.withColumn("section", section).filter(F.col("line").rlike(r"^\s*[^:\s][^:]*:\s*\S"))
    return out.select("file", F.regexp_extract("file", r".*\d+/src_(.*)/[^/]+", 1).alias("variant"), "section", F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", r":\s*(.*)$", 1)).alias("value"))


def read_json_tree(spark: SparkSession, path: str) -> DataFrame:
    """A nested domain document, flattened level by level: (path, parent, scope, depth)."""
    document = spark.read.text(path, wholetext=True).select("value")
    level = document.select(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.get_json_object("value", "$.scope").alias("scope"), F.lit(0).alias("depth"), F.get_json_object("value", "$.domains").alias("rest"))
    out, depth = level, 0
    while level.filter("rest is not null").limit(1).count():
        depth += 1
        kids = level.filter("rest is not null").select("path", F.explode(F.from_json("rest", "map<string,string>")).alias("name", "doc"))
        level = kids.select(F.concat_ws("/", "path", "name").alias("path"), F.col("path").alias("parent"), F.get_json_object("doc", "$.scope").alias("scope"), F.lit(depth).alias("depth"), F.get_json_object("doc", "$.domains").alias("rest"))
        out = out.unionByName(level)
    return out.drop("rest")


def read_work_log(spark: SparkSession, path: str) -> DataFrame:
    """``Www Mmm d hh:mm:ss yyyy subject`` lines: (ts, subject)."""
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    x = spark.read.text(path).select(F.regexp_extract("value", r"^\w{3} (\w{3}) +(\d+) (\d\d:\d\d:\d\d) (\d{4})", 0).alias("d"), F.regexp_replace("value", r"^\w{3} \w{3} +\d+ \d\d:\d\d:\d\d \d{4}( [-+]\d{4})? ?", "").alias("subject"))
    return x.select(F.to_timestamp(F.regexp_replace(F.substring("d", 5, 40), " +", " "), "MMM d HH:mm:ss yyyy").alias("ts"), "subject")


def read_loc(spark: SparkSession, path: str) -> DataFrame:
    """Line counts (lang, problem, variation, loc) summed by key."""
    rows = spark.read.csv(path, header=True)
    return rows.groupBy("lang", "problem", "variation").agg(F.sum(F.col("loc").cast("long")).alias("loc"))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(k, t): the words of one file, numbered through."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")).alias("k", "t"))


def read_row_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sparse rows: rows and non-zeros; each row's length; each row's length again and its ``val col`` pairs; each row's x, b and exact solution.

    Gives (row, col, val) and (i, x, b, exact).
    """
    from pyspark.sql import Window

    words = _tokens(spark, path)
    rows, nonzeros = (int(r["t"]) for r in words.filter("k < 2").orderBy("k").collect())  # two words
    lengths = words.filter((F.col("k") >= 2) & (F.col("k") < 2 + rows)).select((F.col("k") - 2).cast("long").alias("row"), F.col("t").cast("long").alias("n"))
    first = lengths.withColumn("at", F.sum("n").over(Window.orderBy("row")) - F.col("n")).withColumn("at", F.lit(3 + rows) + F.col("row") + F.col("at") * 2)
    spots = first.filter("n > 0").select("row", F.explode(F.expr("sequence(at, at + 2 * n - 2, 2)")).alias("k"))
    coo = spots.join(words.withColumnRenamed("t", "val"), "k").join(words.select((F.col("k") - 1).alias("k"), F.col("t").alias("col")), "k")
    tail = words.filter(F.col("k") >= 2 + 2 * rows + 2 * nonzeros).withColumn("k", F.col("k") - (2 + 2 * rows + 2 * nonzeros))
    vectors = tail.groupBy(F.expr("cast(k div 3 as long)").alias("i")).agg(*(F.max(F.when(F.col("k") % 3 == j, F.col("t").cast("double"))).alias(c) for j, c in enumerate(("x", "b", "exact"))))
    return coo.select("row", F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")), vectors


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Number of bodies, of axes, time; masses; positions; velocities: (id, mass, x, y, z, vx, vy, vz)."""
    words = _tokens(spark, path)
    n = int(words.filter("k = 0").first()["t"])
    k = F.col("k") - 3 - n
    body = F.when(k < 0, F.col("k") - 3).otherwise(F.expr(f"((k - 3 - {n}) % {3 * n}) div 3"))
    part = F.when(k < 0, 0).otherwise(F.lit(1) + k % 3 + F.when(k >= 3 * n, 3).otherwise(0))
    placed = words.filter((F.col("k") >= 3) & (F.col("k") < 3 + 7 * n)).select(body.cast("long").alias("id"), part.alias("part"), F.col("t").cast("double").alias("v"))
    return placed.groupBy("id").agg(*(F.max(F.when(F.col("part") == j, F.col("v"))).alias(c) for j, c in enumerate(("mass", "x", "y", "z", "vx", "vy", "vz"))))
