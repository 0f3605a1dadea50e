"""Words that polynomial hashes confuse, bins against brute force, and the recall of the decontamination."""

import random
import zlib

import numpy as np
import pytest
from gridloom.llm import decontam, ngram_join, packing, tokenids

DOCS = "doc_id long, text string"


def thue_morse(n):
    """A word over a and b and its complement: sums of letters times powers of an odd base agree modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(n) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("name,words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_that_hashes_confuse(name, words):
    P = pytest.importorskip("public_tokenizers")
    e = tokenids.PieceEncoder(P.path(name), words, most=100, longest=10_000, slice_=500)
    texts = [f"x {w} y {w}" for pair in PAIRS for w in pair] + ["a|b |c | |", "x |", "|", "tab\there now", "lone   wide", "\n\na", " ", "  ", "é́ ok"]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in e.encode([t.encode() for t in texts])] == want


def test_packing_against_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "river", "Stone,", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000 + k, w) for k, w in enumerate(w for pair in PAIRS for w in pair)] + [(2000, None), (2001, None), (None, "a"), (None, "a")]
    path = P.path("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(7), lambda: tokenids.PieceEncoder(path, True), capacity=128, open_bins=8, with_ids=True).toPandas()
    from tokenizers import Tokenizer

    tok, seen = Tokenizer.from_file(path), {}
    for doc, text in rows:
        seen.setdefault(doc, []).append([*tok.encode(text or "", add_special_tokens=False).ids, 1])
    for doc, ids in seen.items():
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values(["piece", "sequence_id"])
        pieces = sorted((k, a, i[a : a + 128]) for i in ids for k, a in enumerate(range(0, len(i), 128)))
        assert [(p, s, n, c) for p, s, n, c in mine[["piece", "start", "length", "ids_crc32"]].itertuples(index=False)] == [(k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, a, x in pieces]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *(g.offset + g.length).tolist()[:-1]] and g.length.sum() <= 128
    assert got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // 128)


def test_join_open_in_rounds(spark):
    rng = random.Random(3)
    bins = [((p << 33) + b, rng.randrange(1, 100)) for p in range(40) for b in range(4)]
    got = packing.join_open(spark.createDataFrame(bins, "bin long, free long"), 100, 4, group=3).toPandas()
    used, held = {b: 100 - f for b, f in bins}, {}
    assert sorted(got.old) == sorted(used)
    for r in got.itertuples():
        held.setdefault(r.root, []).append((r.shift, used[r.old]))
    for parts in held.values():
        parts.sort()
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 100
    assert len(held) <= 1.3 * -(-sum(used.values()) // 100)
    assert packing.join_open(spark.createDataFrame([], "bin long, free long"), 100, 4).count() == 0


def test_best_fit_against_brute_force():
    rng = random.Random(4)
    fast, bins, next_ = packing.BestFit(50, 5), {}, 0
    for _ in range(2_000):
        n = rng.randrange(1, 51)
        b, at = fast.put(n)
        fits = sorted(f for f in bins.values() if f >= n)
        if fits:  # the tightest bin that takes it; any of several
            assert bins[b] == fits[0] and at == 50 - fits[0]
        else:
            assert b == next_ and at == 0
            bins[b], next_ = 50, next_ + 1
        bins[b] -= n
        if not bins[b]:
            del bins[b]
        elif len(bins) > 5:  # the fullest closes
            fullest = min(bins.values())
            gone = (set(bins) - set(fast.open())).pop()
            assert bins.pop(gone) == fullest
        assert fast.open() == bins


def test_sets_that_hashes_confuse(spark):
    rows = [(10 * i + j, f"start {w} then {w} end of it all") for i, pair in enumerate(PAIRS) for j, w in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS), k=2, percent=80).collect()}
    assert got == {i: i for i, _ in rows}


def test_id_width():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    assert tokenids.id_width(path, 0) == 2 and tokenids.id_width(path, 70_000) == 3
    with pytest.raises(ValueError):
        tokenids.id_width(path, 70_000, 2)


def test_token_files_of_wide_ids_and_one_id(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    rows = [(7, f"same id {i}") for i in range(50)] + [(None, "x")]
    m = tokenids.write_token_files(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/x", end_id=70_000, block=16)
    got = tokenids.read_token_files(m).collect()
    assert len(got) == 51 and all(np.frombuffer(r.ids, "<u4")[-1] == 70_000 for r in got)
    assert tokenids.write_token_files(spark.createDataFrame([], DOCS), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/y").count() == 0


LENGTHS = [(n, 80) for n in (6, 7, 8, 9, 10, 12, 15, 20, 40)] + [(80, 40), (150, 20), (300, 10), (600, 6)]


@pytest.mark.parametrize("even", [False, True])
def test_recall_at_the_edit_limit(even):
    """Against brute force: every item whose closest range is within its edits; random and evenly spread edits."""
    rng, found, there = np.random.default_rng(5), 0, 0
    text = lambda numbers: " ".join(f"w{x}" for x in numbers).encode()
    for n, trials in LENGTHS:
        items = [rng.integers(0, 5_000, n) for _ in range(trials)]
        docs = [np.concatenate([rng.integers(0, 5_000, 20), decontam.edited(x, decontam.edits(n), rng, even), rng.integers(0, 5_000, 20)]) for x in items]
        block = decontam.Items(list(range(trials)), [text(x) for x in items], 0.99, 2)
        got = {(d, x): distance for d, x, distance, _, _ in block.find([text(d) for d in docs])}
        for i, (x, d) in enumerate(zip(items, docs, strict=True)):
            distance, _, _ = decontam.best_range(x, d)
            assert distance <= decontam.edits(n)
            there, found = there + 1, found + (got.get((i, i)) == distance)
    assert found >= 0.99 * there, (found, there)


def test_long_item_that_a_text_repeats():
    """Memory follows the text: 60 copies of a 1,500-word item."""
    import tracemalloc

    rng = np.random.default_rng(6)
    item = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 1500))
    block = decontam.Items([1], [item.encode()], 0.99, 2)
    tracemalloc.start()
    assert block.find([" ".join([item] * 60).encode()]) == [(0, 0, 0, 0, 1500)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_leaks_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "zz", "x"), (None, "a b c d e f", "x"), (2, None, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, "a b c"), (6, "A, b! c"), (7, "a b"), (None, "d e f")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, block=2).collect()), key=str)
    assert got == sorted(((d, i) for d in (1, None) for i in (5, 6, None)), key=str)
