"""The corpus pipeline: toxicity filter, exact and near deduplication, decontamination, packing.

Every stage reads all that its predecessor kept and decides on each row by itself, also where rows share an id or have
none; all but the last return the columns of ``documents``. Null texts count as empty; other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, decontam, exact_dedup, ngram_join, packing, toxicity


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name.

    That is doc_id, but below all ids for rows that share theirs or have none: only those are written to the shared folder,
    so their numbers stay the same whenever they are read.
    """
    key, other = _fresh(docs, "row_key"), _fresh(docs, "shared_id")
    counts = docs.groupBy(F.col("doc_id").cast("long").alias(other)).agg(F.count("*").alias("n"))
    shared = common.keep(counts.filter(f"n > 1 OR {other} IS NULL").select(other), "shared-ids")
    least = docs.agg(F.least(F.min("doc_id").cast("long"), F.lit(0).cast("long"))).first()[0] or 0
    same = docs["doc_id"].cast("long").eqNullSafe(shared[other])
    numbered = common.keep(docs.join(shared, same, "left_semi").withColumn(key, F.lit(least - 1) - F.monotonically_increasing_id()), "numbered")
    return docs.join(shared, same, "left_anti").withColumn(key, F.col("doc_id").cast("long")).unionByName(numbered), key


def _without(docs: DataFrame, key: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the rows whose key isn't in ``dropped`` (a column doc_id of keys)."""
    gone = dropped.select(F.col("doc_id").alias(_fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs[key] == gone[gone.columns[0]], "left_anti").select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.kept(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id, those before rows that share an id."""
    rows, key = _keyed(docs)
    return _without(rows, key, common.keep(exact_dedup.equal_texts(rows, id_col=key), "equal").filter(~F.col("kept")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest key, of each component of texts that share 80 of 100 of their 5-word shingles."""
    rows, key = _keyed(docs)
    return _without(rows, key, ngram_join.jaccard_components(rows, k=5, percent=80, id_col=key).filter("component_id <> doc_id"), docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = _keyed(docs)
    return _without(rows, key, common.keep(decontam.leaks(rows, common.table(spark, sf_dir, "benchmark"), id_col=key), "leaks"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids: one row per piece of a document."""
    return packing.pack_query(docs, most=1 << 17)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("best-fit packing", pack)]

#: No stage but the exact dedup can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
