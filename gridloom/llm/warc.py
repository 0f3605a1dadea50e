"""WARC archives: writing with an index, and reading selected records by coalesced byte ranges.

Every record is a gzip member of its own. Its row of the index (offset, length, URL, digest and more) is made as it is
written, so archives are never scanned: a reader takes the index rows of the records it wants, orders them by file and
offset, joins ranges that lie close to each other and reads each joined range at once.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"


def _line(value: str | None) -> str:
    """A header's value: line ends would end the header."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with one WARC/1.1 record; a revisit has no payload of its own."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b""
    else:
        block = payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def revisits(pages: DataFrame, least: int, id_col: str, html_col: str, salts: int = 16) -> DataFrame:
    """page_id, sha, size, keeper of rows whose payload, of at least ``least`` bytes, another row with a larger id has too.

    Only ids, sizes and SHA-256 move. Groups of equal payloads are summed up before the shuffle, and the join that brings
    a group's keeper to its rows deals the rows of a group to ``salts`` tasks, so a payload that a third of all pages
    share is in no single task.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html")).filter(F.octet_length("html") >= least)
    known = known.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("size"))
    known = common.keep(known, "payloads")
    groups = known.groupBy("sha", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 AND keeper IS NOT NULL").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = known.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return rows.join(groups, ["sha", "size", "salt"]).filter("NOT page_id <=> keeper").select("page_id", "sha", "size", "keeper").distinct()


def write_warc(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the index (see INDEX), which is itself a table in the shared folder.

    Of rows with equal payloads (SHA-256 and size) of at least ``least`` bytes the one with the largest id is a response
    and the others are revisits that refer to it; of repeated rows with that id each is a response. A null html is an
    empty payload; a null URL an empty target; a row with a null id can be a revisit, but is never referred to. Very long
    payloads are written whole, one at a time. An empty table gives an empty index and no files.
    """
    marks = common.keep(revisits(pages, least, id_col, html_col), "revisits").select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("size").alias("_size"), "keeper")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    # A row's mark is found by its id, so no digest deals out payloads. Spark broadcasts the marks if their size allows it;
    # else payloads move once, by id. The digests tell rows apart that share an id.
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.octet_length("html") == F.col("_size")) & (F.sha2("html", 256) == F.col("_sha"))
    rows = rows.join(marks, same, "left").select("page_id", "url", "html", "keeper")

    def write(batches):
        ctx, out, at, file = TaskContext.get(), None, 0, ""
        for batch in batches:
            for start, htmls in common.text_slices(pa.array(range(batch.num_rows)), batch.column(2)):
                part, index = batch.slice(start[0], len(htmls)), []
                for page, url, refers, payload in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)), htmls, strict=True):
                    if out is None:
                        file = f"{folder}/part-{ctx.partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out = common.open_write(file)
                    digest = hashlib.sha1(payload).hexdigest()
                    kind = "response" if refers is None else "revisit"
                    data = record(kind, page, url, payload, digest, refers)
                    out.write(data)
                    index.append((page, url, file, at, len(data), digest, len(payload), kind, refers))
                    at += len(data)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return common.keep(common.mapped(rows, write, INDEX), "index")


def ranges(spots: list[tuple[int, int]], gap: int, most: int) -> Iterator[list[int]]:
    """Ascending (offset, length) joined into [start, end, first, last] where at most ``gap`` bytes lie between, up to ``most`` bytes."""
    now = None
    for i, (at, n) in enumerate(spots):
        if now and at - now[1] <= gap and at + n - now[0] <= most:
            now[1], now[3] = max(now[1], at + n), i + 1
        else:
            if now:
                yield now
            now = [at, at + n, i, i + 1]
    if now:
        yield now


def read_warc(index: DataFrame, gap: int = 65_536, most: int = 8_000_000, with_payload: bool = True) -> DataFrame:
    """The records of the index rows, read from the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's digest and size are computed from the payload read; a revisit has those that its header gives for the
    full payload.
    """
    spark = index.sparkSession
    spots = index.select("file", "offset", "length").repartition(common.partitions(spark), "file").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches):
        opened, source = None, None
        for batch in batches:
            files, at, n = (c.to_pylist() for c in batch.columns)
            first = 0
            for i in range(1, len(files) + 1):
                if i < len(files) and files[i] == files[first]:
                    continue
                if files[first] != opened:
                    opened, source = files[first], common.open_read(files[first])
                spots = list(zip(at[first:i], n[first:i], strict=True))
                for start, end, a, b in ranges(spots, gap, most):
                    source.seek(start)
                    data, out = source.read(end - start), []
                    for offset, length in spots[a:b]:
                        fields, block = parse(data[offset - start : offset - start + length])
                        out.append(_row(fields, block, with_payload))
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in schema.split(", ")])
                first = i

    return common.mapped(spots, read, schema)


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    def number(name: str) -> int | None:
        v = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return None if v in ("", "None") else int(v)

    kind = fields["WARC-Type"]
    if kind == "revisit":
        size, digest = number("WARC-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        size, digest = len(block), hashlib.sha1(block).hexdigest()
    return (number("WARC-Record-ID"), fields["WARC-Target-URI"], size, digest, kind, number("WARC-Refers-To"), *([block] if with_payload else []))


def op6_warc_index(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    index = write_warc(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return read_warc(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k
"""
