"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokenids import ENCODED_AT_ONCE, PieceEncoder, crc


class BestFit:
    """Bounded-space online best fit.

    At most ``open_bins`` bins are open. A bitset has bit f set while an open bin with f free places exists, so the
    tightest bin that takes an item is the lowest set bit from the item's length on. When one bin too many would be
    open, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.by_free, self.n, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n += 1
            if self.n > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, free_offset(self.capacity, free)

    def open(self) -> dict[int, int]:
        """Open bins and their free places."""
        return {b: f for f, bins in enumerate(self.by_free) for b in bins}


def free_offset(capacity: int, free: int) -> int:
    return capacity - free


def pack_documents(docs: DataFrame, encoder: Callable[[], PieceEncoder], end_id: int = 1, capacity: int = 4096, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, run: str | None = None) -> DataFrame:
    """Packs all documents: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Each partition packs what it reads, so no text is shuffled; bins that are still open at its end are items of further
    packings, of 64 partitions together, then of 64 such groups, and so on (see ``join_open``). A null text counts as
    empty (just ``end_id``); rows that share an id or have none are packed each for itself; only documents over
    ``capacity`` ids are cut; an empty table gives no rows. Texts of any length are encoded whole, slice by slice. Of
    bins with as much room the one that was used last takes an item. ``run``: the run whose encoder a process keeps.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, free long" + ", ids binary" * with_ids)

    def tokens(batches):
        base, packer, enc, waiting = common.task_row_base(), BestFit(capacity, open_bins), None, []
        for batch in batches:
            for ids, texts in common.text_slices(batch.column(0), batch.column(1), ENCODED_AT_ONCE):
                enc = enc or encoder()
                for doc, got in zip(ids, enc.encode(texts), strict=True):
                    got = np.append(got, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(got), capacity)):
                        part = got[at : at + capacity]
                        bin_, place = packer.put(len(part))
                        waiting.append((doc, k, at, len(part), crc(part), base + bin_, place, *([part.tobytes()] if with_ids else [])))
                if len(waiting) > 20_000:
                    open_now = packer.open()
                    yield from _batch([r for r in waiting if r[5] - base not in open_now], 0)
                    waiting = [r for r in waiting if r[5] - base in open_now]
                    if len(waiting) > 20_000:  # many short ones: they don't wait any longer
                        yield from _batch(waiting, 1)
                        waiting = []
        left = packer.open()
        yield from _batch([r for r in waiting if r[5] - base not in left], 0)
        yield from _batch([r for r in waiting if r[5] - base in left], 1)
        # A row of its own for each bin that is open at the end: piece is -1.
        if left:
            n = len(left)
            cols = [pa.nulls(n, pa.int64()), pa.array([-1] * n, pa.int32()), *[pa.array([0] * n, pa.int64())] * 3, pa.array([base + b for b in left], pa.int64()), pa.array([0] * n, pa.int64()), pa.array(list(left.values()), pa.int64()), *[pa.nulls(n, pa.binary())] * with_ids]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    def _batch(rows, maybe_open):
        for a in range(0, len(rows), 20_000):
            part = rows[a : a + 20_000]
            cols = list(zip(*part, strict=True))
            cols.insert(7, [maybe_open] * len(part))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)

    packed = common.keep(common.mapped(rows, tokens, schema, run), "pieces")
    moved = join_open(packed.filter("piece = -1").select("bin", "free"), capacity, open_bins)
    pieces, own = packed.filter("piece >= 0"), ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = ["ids"] if with_ids else []
    closed = pieces.filter("free = 0").select(*own, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), *ids)
    # Spark broadcasts the moves only if their size allows it.
    left = pieces.filter("free > 0").join(moved, F.col("bin") == F.col("old"), "left")
    return closed.unionByName(left.select(*own, F.coalesce("root", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"), *ids))


def join_open(open_: DataFrame, capacity: int, open_bins: int, group: int = 64) -> DataFrame:
    """Packs open bins (bin, free) as items: rows old (the bin), root (the sequence it goes to), shift (its place there).

    Bins of ``group`` neighbouring partitions are packed together, largest first; what is then still open, at most
    ``open_bins`` a group, goes on to the next round, in which ``group`` groups meet. So no task ever has more than
    ``group * open_bins`` items, and the number of rounds is the logarithm of the number of partitions.
    """
    spark, n = open_.sparkSession, common.partitions(open_.sparkSession)
    last = open_.agg(F.max(F.shiftright("bin", 33))).first()[0]
    moves = open_.select(F.col("bin").alias("old"), F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    if last is None:
        return moves

    def pack(batches):
        now, items = None, []

        def flush():
            packer, first, out = BestFit(capacity, open_bins), {}, []
            for root, free in items:
                bin_, place = packer.put(capacity - free)
                first.setdefault(bin_, root)
                out.append((root, first[bin_], place, bin_))
            left = packer.open()
            cols = zip(*((r, f, p, left.get(b, 0)) for r, f, p, b in out), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "to", "by", "rest"])

        for batch in batches:
            for g, free, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now and items:
                    yield flush()
                    items = []
                now = g
                items.append((root, free))
        if items:
            yield flush()

    span = 1
    while span <= last:
        span *= group
        dealt = open_.select(F.expr(f"shiftright(bin, 33) div {span}").alias("g"), "free", "bin").repartition(n, "g").sortWithinPartitions("g", "free", "bin")
        placed = common.keep(common.mapped(dealt, pack, "item long, to long, by long, rest long"), "merge")
        moves = moves.join(placed, F.col("root") == F.col("item"), "left").select("old", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        open_ = placed.filter("rest > 0").groupBy(F.col("to").alias("bin")).agg(F.min("rest").alias("free"))
    return common.keep(moves, "moves")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids of the word vocabulary, each document ended by id 1."""
    return pack_query(common.table(spark, sf_dir, "documents"))


def pack_query(docs: DataFrame, most: int = 1 << 19) -> DataFrame:
    """``most``: pieces that the younger half of an encoder's table holds."""
    import public_tokenizers

    path, run = public_tokenizers.path("word_bpe_49k.json"), uuid.uuid4().hex
    return pack_documents(docs, lambda: PieceEncoder.of_run(run, path, True, most), run=run)
