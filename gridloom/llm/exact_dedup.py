"""Exact deduplication by most-significant-byte-first radix partitioning.

1. Prefix groups that would be too large for one task are found level by level: a level looks at so many leading bytes
   of the documents whose group at the level before was too large. Too large is a fixed share of all bytes, so a level
   has a bounded number of such groups, whatever the input.
2. Each task splits what it has read by successive bytes and keeps one representative of each group of equal texts,
   so a text that a third of all rows share is sent once per task, not once per row.
3. Representatives are dealt out by the shortest prefix that is no large group, and each group is split further, by
   successive bytes, until it is a singleton or has ended. Texts are equal when they have taken the same way to their end;
   no digest decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def radix_groups(texts: list[bytes], width: int = 8) -> Iterator[list[int]]:
    """Places of equal texts. Groups are split by their next ``width`` bytes; the width doubles as a group gets deeper."""
    todo = [(range(len(texts)), 0, width)]
    while todo:
        group, depth, w = todo.pop()
        if len(group) == 1:
            yield list(group)
            continue
        parts: dict[bytes, list[int]] = {}
        ended = []
        for i in group:
            t = texts[i]
            if len(t) <= depth:
                ended.append(i)
            else:
                parts.setdefault(t[depth : depth + w], []).append(i)
        if ended:
            yield ended
        todo += [(p, depth + w, 2 * w) for p in parts.values()]


def large_prefixes(texts: DataFrame, text: str, share: int, first: int = 4, factor: int = 4) -> list[tuple[int, set[bytes]]]:
    """Levels (number of bytes, prefixes whose texts hold over a ``share``-th of all bytes); at most ``share`` a level.

    Copies are sent once per task, so what counts is an estimate of a group's distinct texts times their mean length.
    """
    data = texts.select(F.encode(text, "UTF-8").alias("t"))
    levels: list[tuple[int, set[bytes]]] = []
    total, n = None, first
    while True:
        at = data.withColumn("p", F.substring("t", 1, n))
        if levels:
            before = levels[-1]
            known = texts.sparkSession.createDataFrame([(bytearray(p),) for p in before[1]], "q binary")
            at = at.filter(F.length("t") > before[0]).withColumn("q", F.substring("t", 1, before[0])).join(F.broadcast(known), "q")
        groups = at.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.length("t").cast("long")).alias("bytes"), F.approx_count_distinct(F.xxhash64("t"), 0.1).alias("texts"))
        if total is None:
            total = data.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
        load = F.col("bytes") * F.least(F.lit(1.0), F.col("texts") / F.col("n"))
        found = {bytes(r["p"]) for r in groups.filter((load > total / share) & (F.col("texts") > 8)).select("p").collect()}
        if not found:
            return levels
        levels.append((n, found))
        n *= factor


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16_000_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id stays; of several rows with that id just one
    has ``kept``. A null id is smaller than all others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    levels = large_prefixes(rows, "text", 4 * n)

    def leaf(t: bytes) -> bytes:
        for size, large in levels:
            if len(t) <= size or t[:size] not in large:
                return t[:size]
        return t[: 4 * levels[-1][0]] if levels else t[:4]

    def collapse(batches):
        base, done = common.task_row_base(), 0
        ids, texts, held = [], [], 0

        def flush():
            nonlocal done
            out = []
            for group in radix_groups(texts):
                best = max(group, key=lambda i: (ids[i] is not None, ids[i] or 0))
                rep = base + done + best
                out += [(base + done + i, ids[i], rep, None, None, 0) for i in group if i != best]
                out.append((rep, ids[best], rep, leaf(texts[best]), texts[best], len(group)))
            done += len(texts)
            for start in range(0, len(out), 2_000):
                columns = list(zip(*out[start : start + 2_000], strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "doc_id", "rep", "leaf", "t", "n"])

        for batch in batches:
            for some_ids, some_texts in common.text_slices(batch.column(0), batch.column(1)):
                ids += some_ids
                texts += some_texts
                held += sum(map(len, some_texts))
                if held > chunk_bytes:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush()

    local = common.mapped(rows, collapse, "row long, doc_id long, rep long, leaf binary, t binary, n long")
    # Rows without a text only pass through: they are dealt out by their number.
    dealt = local.repartition(n, F.coalesce("leaf", F.col("row").cast("string").cast("binary"))).sortWithinPartitions("leaf")

    def split(batches):
        group, now = [], None

        def flush():
            out = []
            for same in radix_groups([r[4] for r in group]):
                members = [group[i] for i in same]
                best = max(members, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
                size, sha = sum(r[5] for r in members), hashlib.sha256(best[4]).hexdigest()
                out += [(r[0], r[1], r[2], best[1], best[0], size, sha) for r in members]
            return _classes(out)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                passing = []
                for r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if r[4] is None:
                        passing.append((r[0], r[1], r[2], None, None, None, None))
                        continue
                    if r[3] != now and group:
                        yield flush()
                        group = []
                    now = r[3]
                    group.append(r)
                if passing:
                    yield _classes(passing)
        if group:
            yield flush()

    found = common.mapped(dealt, split, "row long, doc_id long, rep long, keep_id long, keep_row long, n long, sha string")
    # A representative stands for at most what one task has read, so these windows are bounded.
    w = Window.partitionBy("rep")
    return found.select("doc_id", F.max("keep_id").over(w).alias("keep_id"), F.max("n").over(w).alias("group_size"), (F.max("keep_row").over(w) == F.col("row")).alias("kept"), F.max("sha").over(w).alias("text_sha256"))


def _classes(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["row", "doc_id", "rep", "keep_id", "keep_row", "n", "sha"])


def op9_radix_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return equal_texts(common.table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
