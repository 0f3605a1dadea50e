"""Encoding with public tokenizers, and token-id files with bit-plane shuffling.

Encoding a text piece by piece
    Texts repeat their words. A tokenizer whose pre-tokenizer never joins what stands on both sides of a blank gives
    the same ids for a text as for its blank-separated pieces, so each distinct piece is encoded once by the
    tokenizers library and then looked up. Texts in which that isn't certain are encoded whole. A Python process keeps
    what it knows from one task of a run to the next, and drops it with the first task of another run or operator.

File format (one file per range of document ids)
    ``magic | chunk | chunk | ... | index | int64 index offset | magic``. A chunk holds ``block`` ids: the block is
    seen as a matrix of bits, transposed so that all first bits stand together, then all second bits and so on, and
    each of these planes is compressed with zstandard by itself. High planes are almost constant and shrink to
    nothing. The index (JSON, zstandard) has each chunk's offset and its planes' lengths, and the documents' ids and
    token counts as two more compressed arrays.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"BPLANES1"
#: Bytes of text that are cut into pieces together: the more, the rarer a piece is looked up.
ENCODED_AT_ONCE = 4_000_000
_STOPS = (b".", b",")
_DOUBLE_BLANK = re.compile(r"\s\s")


class PieceEncoder:
    """ids of whole texts by a tokenizer file, those of ``encode(text, add_special_tokens=False)``.

    A piece is what stands between two blanks or line feeds, with the one before it. ``words``: the pre-tokenizer drops
    white space (a word vocabulary), so pieces never touch each other; else (byte-level vocabularies) that holds only where
    no two white-space characters follow each other, and other texts are encoded whole. Letters and a stop or comma behind
    them never touch either. Pieces are looked up by their own bytes, never by a hash. About ``2 * most`` are known at a
    time, none longer than ``longest`` bytes: when the younger half is full, it becomes the older one, whose pieces come
    back as they are met again.
    """

    def __init__(self, path: str, words: bool, most: int = 1 << 19, longest: int = 64, slice_: int = 1_000_000):
        # A task has its core for itself; the library's threads would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.most, self.longest, self.slice = Tokenizer.from_file(path), words, most, longest, slice_
        # In a joined text the ids show where a piece of letters begins (byte-level: by its blank) or ends (word ends).
        names = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(names.values(), default=0) + 1, bool)
        self.edge[[i for name, i in names.items() if (name.endswith("</w>") if words else name.startswith(("\u0120", "\u010a")))]] = True
        self.stops = {c: self._library([c.decode()])[0] for c in _STOPS}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of_run(cls, run: str, path: str, words: bool, most: int = 1 << 19) -> PieceEncoder:
        """The encoder of this Python process in a run: empty at the run's start."""
        if run not in common.held:
            common.held.clear()
            common.held[run] = cls(path, words, most)
        return common.held[run]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of letters, in one call of the library."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join([_led(p) for p in pieces]).decode()], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids]) + self.words
        if len(at) != len(pieces):  # the edges don't show
            return self._library([_led(p).decode() for p in pieces])
        cuts, data = (4 * (np.append(0, at) if self.words else np.append(at, len(ids)))).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, missing: set[bytes]) -> tuple[set[bytes], list[bytes]]:
        """The younger half gets all of ``missing`` but pieces whose white space could touch a blank: those, and the too long ones."""
        missing = missing - self._remember(missing)
        letters = [p for p in missing if p.isalpha()]  # of ASCII
        rest = [p for p in missing if not p.isalpha()]
        stopped = [p for p in rest if p.endswith(_STOPS) and (p[:-1].isalpha() or self._plain(p[:-1]))]
        cores = {p[:-1] for p in stopped} - self.young.keys() - missing
        cores -= self._remember(cores)
        letters += cores
        done = set(stopped)
        others = []
        for p in rest:
            if p not in done:
                (letters if self._plain(p) else others).append(p)
        risky = set() if self.words else {p for p in others if _touches(p.decode())}
        others = [p for p in others if p not in risky]
        if letters:
            self.young.update(zip(letters, self._letters(letters), strict=True))
        self.young.update(zip(others, self._library([_led(p).decode() for p in others]), strict=True))
        self.young.update([(p, self.young[p[:-1]] + self.stops[p[-1:]]) for p in stopped])
        return risky, [p for p in (*missing, *cores) if len(p) > self.longest and p not in risky]

    def _remember(self, pieces: set[bytes]) -> set[bytes]:
        """Those of ``pieces`` that the older half has; the younger half gets them."""
        again = self.old.keys() & pieces
        self.young.update([(p, self.old[p]) for p in again])
        return again

    def _plain(self, piece: bytes) -> bool:
        """Whether a piece is of letters that the tokenizer keeps as letters."""
        word = piece.decode().removeprefix("\n")
        return word.isalpha() and (not self.words or word.isascii() or word.lower().isalpha())

    def encode(self, docs: list[bytes]) -> list[np.ndarray]:
        """The ids of each document (UTF-8).

        Arrow cuts the texts and numbers their distinct pieces, so the table is asked once for each of these; the ids
        are then gathered by number.
        """
        of, leads, rests = [], [], []
        for i, d in enumerate(docs):
            at = 0
            while at < len(d):  # a slice ends before a blank
                end = d.find(b" ", at + self.slice)
                end = len(d) if end < 0 else end
                # What stands before the first blank has none; before the first blank of a later slice there is nothing.
                lead, blank, rest = d[at:end].replace(b"\n", b" \n").partition(b" ")
                of.append(i)
                leads.append(lead)
                rests.append(rest if blank else None)
                at = end
        lists = pc.split_pattern(pa.array(rests, pa.binary()), " ")
        bounds, numbered = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        codes, pieces = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.young.get, pieces))
        holes = [k for k, x in enumerate(ids) if x is None]
        risky, long = self._learn({pieces[k] for k in holes})
        for k in holes:
            ids[k] = b"" if pieces[k] in risky else self.young[pieces[k]]
        whole = {i for i, lead in zip(of, leads, strict=True) if not self.words and _touches(lead.decode())}
        if risky:
            hit = np.flatnonzero(np.isin(codes, [k for k in holes if pieces[k] in risky]))
            whole |= {of[k] for k in set((np.searchsorted(bounds, hit, "right") - 1).tolist())}
        starts = [x for x in dict.fromkeys(leads) if x]
        first = {x: np.frombuffer(y, "<u4") for x, y in zip(starts, self._library([x.decode() for x in starts]), strict=True)} | {b"": _NONE}
        known, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = sizes[codes]
        ends = np.cumsum(counts)
        gathered = known[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + counts, counts) + np.arange(counts.sum())]
        cuts = np.append(0, ends)[bounds].tolist()
        out: list[list[np.ndarray]] = [[] for _ in docs]
        for i, lead, a, b in zip(of, leads, cuts[:-1], cuts[1:], strict=True):
            if i not in whole:
                out[i] += (first[lead], gathered[a:b])
        for i in whole:
            out[i] = [np.frombuffer(self._library([docs[i].decode()])[0], "<u4")]
        for p in long:
            self.young.pop(p, None)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        return [np.concatenate(x) if x else _NONE for x in out]


_NONE = np.zeros(0, "<u4")


def _led(piece: bytes) -> bytes:
    """A piece with what stands before it."""
    return piece if piece[:1] == b"\n" else b" " + piece


def _touches(piece: str) -> bool:
    """Whether white space in a piece follows other white space, or could follow or stand before a blank."""
    inner = piece[1:] if piece[:1] == "\n" else piece
    return not inner or inner[0].isspace() or inner[-1].isspace() or bool(_DOUBLE_BLANK.search(inner))


def pack_block(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of a block, most significant byte and bit first: plane b has bit b of every id."""
    zip_, out = zstandard.ZstdCompressor(level=1), []
    for byte in range(width - 1, -1, -1):
        part = (ids >> np.uint32(8 * byte)).astype(np.uint8)
        out += [zip_.compress(np.packbits(part & np.uint8(1 << bit))) for bit in range(7, -1, -1)]
    return out


def unpack_block(planes: list[bytes], n: int, width: int) -> np.ndarray:
    unzip, size = zstandard.ZstdDecompressor(), (n + 7) // 8
    out = np.zeros(n, "<u4")
    for bit, plane in zip(range(8 * width - 1, -1, -1), planes, strict=True):
        row = np.frombuffer(unzip.decompress(plane, max_output_size=size), np.uint8)
        out |= np.unpackbits(row, count=n).astype("<u4") << np.uint32(bit)
    return out


class PlaneWriter:
    def __init__(self, uri: str, width: int, block: int):
        self.out, self.width, self.block = common.open_write(uri), width, block
        self.at, self.chunks, self.waiting, self.n = len(MAGIC), [], [], 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= self.block:
            rest = np.concatenate(self.waiting)
            while len(rest) >= self.block:
                self._chunk(rest[: self.block])
                rest = rest[self.block :]
            self.waiting, self.n = [rest], len(rest)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = pack_block(ids, self.width)
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n:
            self._chunk(np.concatenate(self.waiting))
        zip_ = zstandard.ZstdCompressor(level=3)
        nulls = [i for i, d in enumerate(self.docs) if d is None]
        arrays = [zip_.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes()), zip_.compress(np.array(self.lengths, "<u4").tobytes())]
        head = zip_.compress(json.dumps({"width": self.width, "chunks": self.chunks, "nulls": nulls, "arrays": [len(a) for a in arrays]}).encode())
        for part in (len(head).to_bytes(8, "little"), head, *arrays, self.at.to_bytes(8, "little"), MAGIC):
            self.out.write(part)
        self.out.close()


class PlaneReader:
    """Documents of a file, in the order in which they were written; a chunk at a time is held."""

    def __init__(self, uri: str):
        self.file = common.open_read(uri)
        size = self.file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not complete")
        at = int.from_bytes(tail[:8], "little")
        n = int.from_bytes(self._at(at, 8), "little")
        unzip = zstandard.ZstdDecompressor()
        self.head = json.loads(unzip.decompress(self._at(at + 8, n)))
        a, b = self.head["arrays"]
        self.docs = np.frombuffer(unzip.decompress(self._at(at + 8 + n, a)), "<i8")
        self.lengths = np.frombuffer(unzip.decompress(self._at(at + 8 + n + a, b)), "<u4")

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        nulls, have, chunks = set(self.head["nulls"]), np.zeros(0, "<u4"), iter(self.head["chunks"])
        for i, (doc, n) in enumerate(zip(self.docs.tolist(), self.lengths.tolist(), strict=True)):
            parts, size = [have], len(have)
            while size < n:
                at, count, *sizes = next(chunks)
                data, cuts = self._at(at, sum(sizes)), np.cumsum([0, *sizes])
                parts.append(unpack_block([data[cuts[k] : cuts[k + 1]] for k in range(len(sizes))], count, self.head["width"]))
                size += count
            ids = np.concatenate(parts) if len(parts) > 1 else have
            have = ids[n:]
            yield (None if i in nulls else doc), ids[:n]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def id_width(tokenizer: str, end_id: int, width: int | None = None) -> int:
    """Bytes an id takes: as many as the vocabulary and ``end_id`` need. A ``width`` that is too narrow is refused."""
    from tokenizers import Tokenizer

    least = next(w for w in (1, 2, 3, 4) if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 256**w)
    if width is not None and not least <= width <= 4:
        raise ValueError(f"ids of this vocabulary take {least} bytes, not {width}")
    return width or least


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, block: int = 16_384) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the ids in ascending order of ``id_col`` to plane files.

    Returns the manifest, one row per file that a finished task wrote: part, path, docs, ids. Files of attempts that
    failed are in no manifest. A null text counts as empty; rows without an id come first; rows that share an id all
    stay, in the order of a hash of their texts, and may stand in several files; very long texts are encoded slice by
    slice; an empty table gives no files. ``width``: bytes an id, as many as the vocabulary needs if not given.
    """
    spark, width, run = docs.sparkSession, id_width(tokenizer, end_id, width), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    # The hash and the row's number let rows that share an id go to several files.
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")

    def write(batches):
        ctx = TaskContext.get()
        encoder = writer = None
        path = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.planes"
        for batch in batches:
            for ids, texts in common.text_slices(batch.column(0), batch.column(1), ENCODED_AT_ONCE):
                encoder = encoder or PieceEncoder.of_run(run, tokenizer, words=False)
                writer = writer or PlaneWriter(path, width, block)
                for doc, got in zip(ids, encoder.encode(texts), strict=True):
                    writer.add(doc, np.append(got, np.uint32(end_id)))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([ctx.partitionId()], pa.int32()), "path": [path], "docs": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([sum(writer.lengths)], pa.int64())})

    return common.keep(common.mapped(rows, write, "part int, path string, docs long, ids long", run), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32, ids (binary).

    The driver adds up the files' counts: one small row per file, as many as there are partitions.
    """
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["path"], start))
        start += r["ids"]
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files, "path string, start long").repartition(len(files), "path")

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc, ids in PlaneReader(path):
                    rows.append((doc, at, len(ids), crc(ids), *([ids.tobytes()] if with_ids else [])))
                    at += len(ids)
                    held += len(ids)
                    if held > 1_000_000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        columns = list(zip(*rows, strict=True))
        types = [*[pa.int64()] * 4, *[pa.binary()] * with_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return common.mapped(listed, read, schema)


def op5_token_planes(spark, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark, "planes"))
    return read_token_files(manifest, with_ids=False)
