"""Jaccard self-join of documents on word shingles: a grouped prefix join.

Order. Any order of shingles gives right results; rare ones first gives few candidates. Counts come from every document:
each task counts all shingles that it reads and passes on those it has seen more than once; the ``frequent`` most
frequent ones of the sums (a bounded table) go to the end of the order, all others stand before them by hash.

Prefixes and groups. Two documents that link share l = min(SHARED, ceil(t n)) shingles among their first
n - ceil(t n) + l, so pairs that meet less often, as texts do by chance, are no candidates. Documents with the
same set are one class, classes with the same prefix and size one group, and only groups are posted under the
shingles of their prefix.

Candidates without squares. In a first round each group takes one hub of a fitting size from its posting lists, classes are
verified against their hubs and linked classes are contracted. A family of near copies, whatever its size, is then one
component. In a second round posting lists give every pair of groups of *different* components that passes the size
and position filters, group pairs are expanded to their classes and verified. So no link that joins two components is lost.

Verification computes both sets from the whole texts and compares 100 * common >= percent * union. Words are told apart
by their bytes, shingles by 128 bits of their words' xxh3; candidates are found by the first 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import Words, common_shingles, shingle_sets

_BITS = np.uint64((1 << 24) - 1)
#: Shingles that the prefixes of linked documents must share, as far as they have so many.
SHARED = 4


def need(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m shingles: ceil(p (n + m) / (100 + p))."""
    return -(-percent * (n + m) // (100 + percent))


def frequent_shingles(rows: DataFrame, k: int, most: int, chunk: int = 2_000_000) -> np.ndarray:
    """Hashes of the most frequent shingles, rarest first: at most ``most``, so the table that is sent out is bounded."""

    def count(batches):
        held, size = [], 0

        def flush():
            a = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            n = np.diff(np.append(at, len(a)))
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(a[at[often]].view(np.int64)), pa.array(n[often])], ["h", "n"])

        for batch in batches:
            for _, texts in common.text_slices(batch.column(0), batch.column(1)):
                for s in Words(texts).shingles(k):
                    held.append(s)
                    size += len(s)
                if size > chunk:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    sums = common.keep(common.mapped(rows, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    # The least count that keeps the table within its bound, from a histogram of counts in powers of sqrt(2).
    level = F.floor(2 * F.log2("n")).cast("int")
    left, least = most, None
    for r in sums.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    if least is None:
        return np.zeros(0, np.uint64)
    table = sums.filter(level >= least).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return h[np.lexsort((h, n))]


def signatures(rows: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), fp (of the whole set), gid (of size and prefix), prefix (in the order of the join)."""
    spark = rows.sparkSession
    order = np.argsort(frequent, kind="stable")
    shared = spark.sparkContext.broadcast((frequent[order], order))

    def sign(batches):
        table, rank = shared.value
        seen = np.zeros(1 << 24, bool)
        seen[(table & _BITS).astype(np.int64)] = True
        for batch in batches:
            for ids, texts in common.text_slices(batch.column(0), batch.column(1)):
                fps, gids, sizes, prefixes = [], [], [], []
                for u, more in shingle_sets(texts, k):
                    n = len(u)
                    sizes.append(n)
                    if not n:
                        fps.append(None), gids.append(None), prefixes.append(None)
                        continue
                    least = -(-percent * n // 100)
                    p = n - least + min(SHARED, least)
                    maybe = np.flatnonzero(seen[(u & _BITS).astype(np.int64)])
                    at = np.searchsorted(table, u[maybe])
                    real = at < len(table)
                    real[real] = table[at[real]] == u[maybe[real]]
                    late, at = maybe[real], at[real]
                    early = np.delete(u, late) if len(late) else u
                    prefix = early[:p]
                    if len(prefix) < p:
                        prefix = np.concatenate([prefix, u[late[np.argsort(rank_of(rank, at))]][: p - len(prefix)]])
                    fps.append(xxhash.xxh3_128_digest(u.tobytes() + more.tobytes()))
                    gids.append(xxhash.xxh3_64_intdigest(prefix.tobytes(), n) - (1 << 63))
                    prefixes.append(prefix.view(np.int64))
                lens = np.cumsum([0, *(0 if p is None else len(p) for p in prefixes)])
                flat = np.concatenate([np.zeros(0, np.int64), *(p for p in prefixes if p is not None)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(gids, pa.int64()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat))], ["doc_id", "n", "fp", "gid", "prefix"])

    def rank_of(rank, at):
        return rank[at]

    return common.mapped(rows, sign, "doc_id long, n long, fp binary, gid long, prefix array<long>")


def _lists(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """A partition's postings, ordered by token and size, without the tokens that stand alone."""
    table = pa.Table.from_batches(list(batches))
    cols = {c: table[c].to_numpy() for c in table.column_names}
    o = np.lexsort((*([cols["label"]] if "label" in cols else []), cols["gid"], cols["n"], cols["token"]))
    t = cols["token"][o]
    same = np.concatenate([[False], t[1:] == t[:-1], [False]])
    o = o[same[1:] | same[:-1]]
    return {c: v[o] for c, v in cols.items()}


def _fitting(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each posting the range of postings of its list whose sizes allow a link."""
    new = np.concatenate([[True], x["token"][1:] != x["token"][:-1]])
    key = (np.cumsum(new) << 32).astype(np.int64)
    sizes = key + x["n"]
    return np.searchsorted(sizes, key - (-percent * x["n"] // 100), "left"), np.searchsorted(sizes, key + 100 * x["n"] // percent, "right")


def postings(signed: DataFrame, percent: int) -> DataFrame:
    """token, gid, n, pos of tokens that more than one group has."""
    n = common.partitions(signed.sparkSession)
    groups = signed.filter("n > 0").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))

    def live(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            x = _lists(batches)
            for a in range(0, len(x["gid"]), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["token"][b], x["gid"][b], x["n"][b].astype(np.int32), x["pos"][b].astype(np.int32))], ["token", "gid", "n", "pos"])

    return common.mapped(posted.repartition(n, "token"), live, "token long, gid long, n int, pos int")


def hubs(live: DataFrame, percent: int) -> DataFrame:
    """gid, hub: the group of a fitting size that shares the most of its prefix with others, of those the lists name.

    The text that copies were made from has no shingle of its own, so all of its prefix is shared: each list names its
    group with the most shared postings, and where that is too long or too short the next smaller one.
    """
    n = common.partitions(live.sparkSession)
    rated = live.join(live.groupBy("gid").agg(F.count("*").cast("int").alias("shared")), "gid").select("token", "gid", "n", "shared")

    def name(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        x = _lists(batches)
        if not len(x["gid"]):
            return
        x = {k: v.astype(np.int64) for k, v in x.items()}
        lo, hi = _fitting(x, percent)
        here = np.arange(len(lo))
        start = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
        list_ = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(lo))))
        by = np.lexsort((x["gid"], -x["shared"], list_))
        top = by[start][list_]
        hub = np.where((top >= lo) & (top < hi), top, np.maximum(lo, here - 1))
        u, votes = np.unique(np.stack([x["gid"], x["n"], x["shared"][hub], x["gid"][hub]], 1)[hub != here], axis=0, return_counts=True)
        for a in range(0, len(u), 50_000):
            b = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(u[b, k]) for k in range(4)), pa.array(votes[b])], ["gid", "n", "shared", "hub", "votes"])

    named = common.mapped(rated.repartition(n, "token"), name, "gid long, n long, shared long, hub long, votes long")
    named = named.groupBy("gid", "n", "shared", "hub").agg(F.sum("votes").alias("votes")).filter(F.col("votes") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100)))
    return named.groupBy("gid").agg(F.max(F.struct("shared", "votes", "hub")).getField("hub").alias("hub"))


def cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (gid, label) of groups under a common token with different labels that pass the size and position filters."""
    n = common.partitions(entries.sparkSession)

    def pairs(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        x = _lists(batches)
        if not len(x["gid"]):
            return
        x = {k: v.astype(np.int64) for k, v in x.items()}
        lo, hi = _fitting(x, percent)
        here = np.arange(len(hi))
        # Lists, or ranges of them, in which all have one label give nothing.
        change = np.concatenate([[0], np.cumsum(x["label"][1:] != x["label"][:-1])])
        count = np.where(change[hi - 1] != change[here], hi - here - 1, 0)
        for a in np.split(here, np.searchsorted(np.cumsum(count), np.arange(1, count.sum() // 500_000 + 1) * 500_000)):
            c = count[a]
            i = np.repeat(a, c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            # Common tokens before this one are posted ones of both; holds for the first SHARED ones of a pair that links.
            before = np.minimum(SHARED - 1, np.minimum(x["before"][i], x["before"][j]))
            bound = before + np.minimum(x["n"][i] - x["pos"][i], x["n"][j] - x["pos"][j])
            good = (x["label"][i] != x["label"][j]) & (bound * (100 + percent) >= percent * (x["n"][i] + x["n"][j]))
            i, j = i[good], j[good]
            if len(i):
                enough = np.minimum(SHARED, -(-percent * np.minimum(x["n"][i], x["n"][j]) // 100))
                u, which = np.unique(np.stack([x["gid"][i], x["label"][i], x["gid"][j], x["label"][j], enough], 1), axis=0, return_inverse=True)
                met = np.bincount(which.ravel(), weights=x["weight"][i]).astype(np.int64)
                for b in range(0, len(u), 50_000):
                    yield pa.RecordBatch.from_arrays([*(pa.array(u[b : b + 50_000, k]) for k in range(5)), pa.array(met[b : b + 50_000])], ["g1", "l1", "g2", "l2", "enough", "met"])

    found = common.mapped(entries.repartition(n, "token"), pairs, "g1 long, l1 long, g2 long, l2 long, enough long, met long")
    # A pair of sizes n, m can come in either order of its groups only if n = m and then always by gid.
    return found.groupBy("g1", "l1", "g2", "l2").agg(F.sum("met").alias("met"), F.max("enough").alias("enough")).filter("met >= enough").select("g1", "l1", "g2", "l2")


def verified(pairs: DataFrame, sources: DataFrame, rows: DataFrame, k: int, percent: int, most: int = 500) -> DataFrame:
    """Those pairs (a, b) of class fingerprints whose sets link. sources: fp, doc_id of one document of each class.

    The texts of the documents that take part move twice: to their pairs, then to the b's; a b with many a's is copied to
    several tasks, ``most`` a's each, and a task holds the set of one b and one a at a time.
    """
    spark = pairs.sparkSession
    n = common.partitions(spark)
    pairs = common.keep(pairs.select("a", "b").distinct(), "pairs")
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    hubs = shares.select(F.col("b").alias("fp"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("a"))
    spokes = pairs.join(shares, "b").select(F.col("a").alias("fp"), "b", F.pmod(F.xxhash64("a"), F.col("shares").cast("long")).cast("int").alias("share"), "a")
    wanted = sources.select("fp", F.col("doc_id").alias("_id")).join(hubs.unionByName(spokes), "fp")
    wanted = common.keep(wanted, "wanted")
    # Documents that surely aren't wanted are left out before the shuffle, by a bitset of fixed size; the join is exact.
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 23)).cast("int")
    at = wanted.select(F.pmod(F.xxhash64("_id"), F.lit(1 << 23)).cast("int").alias("b")).distinct()
    set_ = at.groupBy(F.shiftright("b", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, b & 7))").alias("v")).toArrow()
    bits = np.zeros(1 << 20, np.uint8)
    bits[set_["byte"].to_numpy()] = set_["v"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def maybe(batches):
        for batch in batches:
            b = batch.column(2).to_numpy()
            on = (shared.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["_doc", "text"]).filter(pa.array(on.astype(bool)))

    texts = common.mapped(rows.select("doc_id", "text", spot.alias("spot")), maybe, "_doc long, text string")
    # Both sides grow with the corpus, so neither is ever broadcast.
    sent = texts.join(wanted.hint("merge"), texts["_doc"].eqNullSafe(wanted["_id"])).select("b", "share", "a", "fp", "text")
    dealt = sent.repartition(n, "b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())

    def compare(batches):
        now, own = None, None
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = part.column(4).cast(pa.binary()).to_pylist()
                sets = shingle_sets(texts, k)
                for b, share, a, fp, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), sets, strict=True):
                    if not len(u[0]) or xxhash.xxh3_128_digest(u[0].tobytes() + u[1].tobytes()) != fp:
                        continue  # another row with the same doc_id
                    if a is None:
                        now, own = (b, share), u
                    elif now == (b, share):
                        both = common_shingles(own, u)
                        if 100 * both >= percent * (len(own[0]) + len(u[0]) - both):
                            out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return common.keep(common.mapped(dealt, compare, "a binary, b binary").distinct(), "linked")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links lead to, itself included).

    Texts are lower-cased (A to Z) and cut at ASCII white space; a document with fewer than k words has its whole
    sequence as its one shingle. A document without words (empty or null text) links with nothing, not even its like.
    Rows that share an id are judged each for itself; a null id is never the smallest of a component with ids.
    Very long texts are read whole, a document at a time. ``frequent`` bounds the table of frequent shingles that is
    sent to each task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    signed = common.keep(signatures(rows, k, percent, frequent_shingles(rows, k, frequent)), "signed")
    classes = signed.filter("n > 0").groupBy("fp").agg(F.first("n").cast("int").alias("n"), F.first("gid").alias("gid"), F.min("doc_id").alias("doc_id"))
    classes = common.keep(classes, "classes")
    live = common.keep(postings(signed, percent), "postings")

    # Round 1: every class against the first class of its group, every group's first class against its hub's.
    firsts = classes.groupBy("gid").agg(F.min("fp").alias("rep"))
    inside = classes.join(firsts, "gid").filter("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    other = firsts.select(F.col("gid").alias("hub"), F.col("rep").alias("b"))
    outside = hubs(live, percent).join(firsts, "gid").join(other, "hub").select(F.col("rep").alias("a"), "b")
    one = verified(inside.unionByName(outside), classes, rows, k, percent)
    labels = components(one, "a", "b")

    # Round 2: every pair of different components that a posting list or a group brings together.
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "n", "gid", F.xxhash64(F.coalesce("label", "fp")).alias("label"))
    named = common.keep(named, "named")
    sets = named.groupBy("gid", "label").agg(F.first("n").alias("n"))
    placed = live.select("token", "gid", "pos", (F.row_number().over(Window.partitionBy("gid").orderBy("pos")) - 1).alias("before"))
    entries = placed.join(sets, "gid").select("token", "gid", "label", "n", "pos", "before", F.lit(1).alias("weight"))
    split = sets.join(sets.groupBy("gid").count().filter("count > 1").select("gid"), "gid")
    entries = entries.unionByName(split.select(F.col("gid").alias("token"), "gid", "label", "n", F.lit(0).alias("pos"), F.lit(0).alias("before"), F.lit(SHARED).alias("weight")))
    met = common.keep(cross_pairs(entries, percent), "met")
    left = named.select(F.col("gid").alias("g1"), F.col("label").alias("l1"), F.col("fp").alias("a"))
    right = named.select(F.col("gid").alias("g2"), F.col("label").alias("l2"), F.col("fp").alias("b"))
    two = verified(met.join(left, ["g1", "l1"]).join(right, ["g2", "l2"]).select("a", "b"), classes, rows, k, percent)

    labels = common.keep(components(one.unionByName(two), "a", "b"), "labels")
    known = classes.select("fp", "doc_id").join(labels, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = known.join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
    out = signed.select("doc_id", "n", "fp").join(ids, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share at least 85 of 100 of their distinct 4-word shingles."""
    return jaccard_components(common.table(spark, sf_dir, "documents"), k=4, percent=85)


OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), n AS (SELECT doc_id, len(s) AS n FROM sets), one AS (SELECT doc_id, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) AS component_id
FROM n LEFT JOIN reach r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
