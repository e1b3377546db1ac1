import zlib

import numpy as np

import corpus_pipeline
from tallyroom.llm import word_bpe
from tests.llm import cases
from tests.llm.test_ngram_jaccard import brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == columns, name
        rows, before = [tuple(r) for r in out.collect()], [tuple(r) for r in docs.collect()]
        assert set(rows) <= set(before) and len(rows) == len(set(rows))
        texts = {r[0]: r[1] for r in before}
        kept = {r[0] for r in rows}
        if name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                k = (t or "").encode().lower()
                best[k] = max(i, best.get(k, i))
            assert kept == set(best.values())
        if name == "near_copies":
            assert kept == {i for (i, _), c in brute(before, 5, 8, 10).items() if i == c}
        docs = out
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    encoder = word_bpe.load(word_bpe.default_path())
    ids = {r.doc_id: np.frombuffer(encoder.library(r.text or ""), "<u4").tolist() + [1] for r in docs.collect()}
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        got.setdefault(p.doc_id, []).extend(part)
    assert got == ids


def test_run_equals_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_clean_documents_and_odd_rows_stay(spark, sf):
    docs = cases.docs(spark)
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
