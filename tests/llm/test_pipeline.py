"""The pipeline's stages, one after the other, against what was planted: toxic, copied, nearly copied and leaked documents."""

import random

import corpus_pipeline
import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, length string"


def tables(spark, tmp_path, rows, labels, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "c", "l") for i, t in rows], NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def through(spark, path):
    """Ids after each stage but the last, and the last stage's rows."""
    docs, kept = corpus_pipeline.common.table(spark, path, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.keep(stage(spark, docs, path), "stage")
        assert docs.columns == columns, name
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, path).toPandas()


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(5)
    words = [f"u{k}" for k in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    base = [(i, text() + (" you moron" * 3 if i % 5 == 0 else "")) for i in range(240)]
    item = " ".join(f"q{k}" for k in range(20))
    near = base[2][1].split()
    near[30] = "changed"
    rows = [*base, (300, base[1][1]), (301, " ".join(near)), (302, text() + " " + item), (303, None), (304, ""), (305, text() + " end" * 9000)]
    path = tables(spark, tmp_path, rows, [(i, 1, int(i % 5 == 0)) for i in range(240)], [(7, item), (8, None)])
    (calm, single, apart, clean), packed = through(spark, path)
    toxic = {i for i in range(240) if i % 5 == 0}
    assert set(calm) == {i for i, _ in rows} - toxic
    assert set(single) == set(calm) - {1, 303}
    assert set(apart) == set(single) - {301}
    assert set(clean) == set(apart) - {302} and len(clean) == len(set(clean))
    assert set(packed.doc_id) == set(clean)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *(g.offset + g.length).tolist()[:-1]] and g.length.sum() <= 4096
    assert packed[packed.doc_id == 305].sort_values("piece").length.tolist()[:-1] == [4096] * (len(packed[packed.doc_id == 305]) - 1)


def test_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    kept, packed = through(spark, tables(spark, tmp_path, [], [], []))
    assert kept == [[]] * 4 and not len(packed)
