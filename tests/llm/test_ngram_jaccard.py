import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import blocks, common, ngram_jaccard
from tallyroom.llm.common import Scratch, components
from tests.llm import cases


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, num, den):
    """{doc_id: (set size, smallest id reachable)} by all pairs."""
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    label = {i: i for i, _ in sets if i is not None}
    find = lambda i: i if label[i] == i else find(label[i])
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            common = len(s & t)
            if a is not None and b is not None and common and den * common >= num * (len(s) + len(t) - common):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {(i, len(s)): find(i) if i is not None else None for i, s in sets}


def corpus(seed, n=140):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "OF", "and"] * 10
    passage = list(rng.choice(words, 30))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = rows[int(rng.integers(0, len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            if rng.random() < 0.2:
                text = [w.upper() for w in text]
        else:
            text = list(rng.choice(words, int(rng.integers(1, 80))))
            if rng.random() < 0.3:
                text += passage
        rows.append((int(i * 7 % 1000 + 5), " ".join(text), "", ""))
    return rows


@pytest.mark.parametrize("size, num, den, group", [(3, 90, 100, 512), (5, 8, 10, 512), (3, 7, 10, 8), (2, 1, 2, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, size, num, den, group):
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    rows = corpus(size + group) + [r for r in cases.ROWS if r[0] is None or r[0] < 5] + [cases.ROWS[6], cases.ROWS[7]]
    got = ngram_jaccard.groups(cases.docs(spark, rows), size, Fraction(num, den), block_bytes=3000).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute(rows, size, num, den)


@pytest.mark.parametrize("group", [16, 512])
def test_one_family_of_dissimilar_documents(spark, monkeypatch, group):
    """Short texts over few words: shared tokens tie all of them together, yet few link, and few pairs are candidates."""
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    rng = np.random.default_rng(2)
    words = [f"v{k}" for k in range(9)]
    rows = [(i, " ".join(rng.choice(words, 12)), "", "") for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " v1", "", "") for i in range(0, 60, 2)]
    seen = []
    candidates = ngram_jaccard.candidate_pairs
    monkeypatch.setattr(ngram_jaccard, "candidate_pairs", lambda large, t: seen.append((large.count(), candidates(large, t).count())) or candidates(large, t))
    got = ngram_jaccard.groups(cases.docs(spark, rows), 3, "0.9").collect()
    want = brute(rows, 3, 90, 100)
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == want
    assert sum(c != i for (i, _), c in want.items()) >= 30
    assert seen and seen[0][0] > 1000 and seen[0][1] < 20 * seen[0][0], seen


@pytest.mark.parametrize("shift", [40, 60])
def test_keys_that_are_counted_together(spark, monkeypatch, shift):
    """Frequencies only order tokens: with sixteen counters for all of them, the groups are the same."""
    monkeypatch.setattr(ngram_jaccard, "COUNT_SHIFT", shift)
    rows = corpus(31)
    got = ngram_jaccard.groups(cases.docs(spark, rows), 3, "0.8", block_bytes=3000).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute(rows, 3, 8, 10)


def test_shuffled_keys_take_half_their_width():
    rng = np.random.default_rng(4)
    words, ids = rng.integers(0, 2**64, 300_000, dtype=np.uint64), np.arange(1)
    row = blocks._block(0, list(ids), [words])
    (asked,) = ngram_jaccard._ask(5, 16, ngram_jaccard.COUNT_SHIFT)(iter([row]))
    assert sum(len(k) for k in asked.column(2).to_pylist()) < 4.5 * (len(words) - 4)


def test_kept_tables_leave_no_shuffle_files(spark):
    """What a step shuffled is gone before the next, and the session's setting is as it was."""
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(f) for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(common.SHUFFLE_CLEANUP)
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(50_000).groupBy(F.col("id") % 1000).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 1000
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == setting


def test_one_large_class_of_equal_sets(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rows = corpus(9, 60) + [(5000 + i, "a text that a third of all documents have word by word", "", "") for i in range(80)]
    rows += [(6000, "a text that a third of all documents have word by word too", "", ""), (6000, "other", "", "")]
    got = ngram_jaccard.groups(cases.docs(spark, rows), 3, "0.8").collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got if r.doc_id != 6000} == {k: v for k, v in brute(rows, 3, 8, 10).items() if k[0] != 6000}


def test_odd_rows(spark):
    got = ngram_jaccard.groups(cases.docs(spark), 3, "0.9").collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in got} == brute(cases.ROWS, 3, 9, 10)
    assert ngram_jaccard.groups(cases.docs(spark, []), 3, "0.9").count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = cases.docs(spark)
    kept = ngram_jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: x or 0) == [None, 1, 3, 4, 5, 7, 7, 8, 9, 10, 11]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in rng.integers(101, 160, 80)] + [(5, 5)] + [(500, 600), (600, 700), (550, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(c == 100 for n, c in got.items() if 100 <= n < 200) and all(got[n] == 500 for n in (500, 550, 600, 700))


def test_packing_of_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    assert (blocks.unpack_keys(blocks.pack_keys(keys)) == keys).all()
    at = blocks.bounds(keys, 16)
    assert all((keys[a:b] >> np.uint64(60) == i).all() for i, (a, b) in enumerate(zip(at, at[1:])))
    assert blocks.bounds(keys[:0], 16).tolist() == [0] * 17
