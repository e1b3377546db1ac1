import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import common, exact_dedup, packing, token_file, word_bpe
from tallyroom.llm.common import Scratch
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng = np.random.default_rng(5)
    letters = list("aB éÉßΣςİı'’s.,!?-_#́  ẞ\x1c\x85　\tçñÑ12٣中あ🙂\nſﬁ") + ["<|endoftext|>", "'ll", "don't"]
    assert library("a <|endoftext|> b") == [320, 49407, 321]
    texts = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(3000)] + [r[1] for r in cases.ROWS]
    ids, sizes = word_bpe.load(word_bpe.default_path()).encode_batch(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes, ends):
        assert ids[end - size : end].tolist() == library(text), text


def test_other_tokenizer_files_go_through_the_library(library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = word_bpe.WordBpe(path)
    assert not encoder.by_chunk
    ids, sizes = encoder.encode_batch(pa.array(["a b  c", None, ""]))
    assert ids.tolist() == encoder.tokenizer.encode("a b  c", add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0, 0]


@pytest.mark.parametrize("counts", [[5], [0, 3, 0], [1, 1], [1] * 300, [2**k for k in range(40)], list(range(1, 3000))])
def test_code_is_optimal_and_limited(counts):
    counts = np.array(counts, np.int64)
    lengths = token_file.code_lengths(counts)
    used = lengths[counts > 0].astype(int)
    assert used.max() <= token_file.MAX_BITS and (lengths[counts == 0] == 0).all()
    assert sum(2.0**-x for x in used) <= 1
    import heapq

    heap = [(int(c), 0) for c in counts if c]
    total = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]) + 1))
    if heap[0][1] <= token_file.MAX_BITS and len(used) > 1:  # the limit doesn't bind: as short as Huffman's
        assert (counts * lengths).sum() == total


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 4000).astype(np.uint32)
    codec = token_file.Codec(token_file.code_lengths(np.bincount(ids, minlength=4001)))
    sizes = np.array([n // 2, 0, n - n // 2], np.int64)
    block = token_file.pack_block(codec, np.array([4, 5, -(2**63)]), sizes, ids)
    doc_ids, got_sizes, got = token_file.unpack_block(codec, block)
    assert doc_ids.tolist() == [4, 5, -(2**63)] and got_sizes.tolist() == sizes.tolist() and got.tolist() == ids.tolist()
    if n > 500:
        bad = bytearray(block)
        bad[-20] ^= 0x55
        with pytest.raises(ValueError):
            token_file.unpack_block(codec, bytes(bad))


def _rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_files(spark, library, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 50)
    folder = Scratch(spark, "t").base + "/data"
    token_file.write_tokens(cases.docs(spark), folder, word_bpe.default_path(), 2)
    got = token_file.read_tokens(spark, folder).orderBy("start").collect()
    start = 0
    for (doc_id, text, *_), r in zip(_rows(cases.ROWS), got, strict=True):
        ids = library(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids = {r.doc_id: r.ids for r in token_file.decode_ids(spark, folder).collect()}
    assert ids[1] == library(cases.ROWS[0][1]) + [2]


def test_token_files_of_no_rows(spark):
    folder = Scratch(spark, "t").base + "/data"
    token_file.write_tokens(cases.docs(spark, []), folder, word_bpe.default_path(), 2)
    assert token_file.read_tokens(spark, folder).count() == 0


def padding(sizes, window):
    return sum(0 if s & (s - 1) == 0 else window - s for s in sizes)


def brute_cost(places, cost, window):
    at = places.tolist()
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + (0 if (s := at[j] - at[i]) & (s - 1) == 0 else window - s) for i in range(j) if at[j] - at[i] <= window) + int(cost[j])
    return best[-1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 120, rng.integers(1, 12)).astype(np.int64)
        n = int(sizes.sum())
        sentence = np.unique(rng.integers(1, n + 1, n // 15 + 1))
        places, cost = packing.cut_points(sizes, sentence)
        ends = packing.best_cuts(places, cost, 64)
        got = np.diff([0, *ends])
        price = dict(zip(places.tolist(), cost.tolist()))
        assert ends[-1] == n and got.max() <= 64 and got.min() > 0
        assert padding(got.tolist(), 64) + sum(price[e] for e in ends) == brute_cost(places, cost, 64)


def check_pieces(rows, texts, library, end_id, window):
    ids = {k: library(t) + [end_id] for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[k])
    assert by_doc.keys() == ids.keys() and sorted(by_seq) == list(range(len(by_seq)))
    sizes = []
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        sizes.append(at)
    return sizes


def test_packing(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_TOKENS", 3000)
    rows = [r for r in cases.ROWS if r[0] is not None]
    rows = rows[:6] + rows[7:]  # one row per id, so that pieces can be told apart
    out = packing.pack(cases.docs(spark, rows), word_bpe.default_path(), 1).collect()
    check_pieces(out, {r[0]: r[1] for r in rows}, library, 1, 2048)
    repeated = packing.pack(cases.docs(spark), word_bpe.default_path(), 1)
    assert repeated.where("doc_id is null").count() == 1
    assert repeated.where("doc_id = 7 and start = 0").count() == 2
    assert packing.pack(cases.docs(spark, []), word_bpe.default_path(), 1).count() == 0


def test_packing_of_documents(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = check_pieces(packing.pack(docs, word_bpe.default_path(), 1).collect(), texts, library, 1, 2048)
    assert padding(sizes, 2048) < 0.02 * sum(sizes)


def test_exact_groups(spark):
    import hashlib

    got = exact_dedup.exact_groups(cases.docs(spark)).collect()
    assert len(got) == len(cases.ROWS)
    groups = {}
    for doc_id, text, *_ in cases.ROWS:
        groups.setdefault(hashlib.sha256((text or "").encode().lower()).hexdigest(), []).append(doc_id)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids) and r.kept == (r.doc_id == r.keep_id)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert exact_dedup.exact_groups(cases.docs(spark, [])).count() == 0


def test_index_grows_by_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 4)
    first, second = cases.ROWS[:5], [(21, "the quick brown fox jumps over the lazy dog. and runs away.", "", ""), (22, "new", "", ""), (23, "NEW", "", "")]
    exact_dedup.exact_groups(cases.docs(spark, first), index=index).collect()
    got = {r.doc_id: r for r in exact_dedup.exact_groups(cases.docs(spark, second), index=index).collect()}
    assert not got[21].kept and got[21].keep_id is None
    assert got[23].kept and not got[22].kept and got[22].keep_id == 23
    assert index.read().count() == index.read().select("digest").distinct().count() == 4
    index.drop()


def test_batches_of_falling_ids_and_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rng = np.random.default_rng(6)
    rows = [(int(i), ("hot text" if rng.random() < 0.5 else f"text {rng.integers(0, 40)}").title(), "", "") for i in rng.permutation(300)]
    rows += [(None, "Hot Text", "", ""), (None, "only here", "", ""), (7, "twice", "", ""), (7, "Twice", "", "")]
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    for batches in (1, 2, 5):
        got = exact_dedup.exact_groups(cases.docs(spark, rows), batches=batches).collect()
        best, size = {}, {}
        for i, t, *_ in rows:
            k = t.lower()
            best[k] = i if best.get(k) is None else max(best[k], i if i is not None else best[k])
            size[k] = size.get(k, 0) + 1
        want = sorted((repr(i), repr(best[t.lower()]), size[t.lower()], i == best[t.lower()]) for i, t, *_ in rows)
        assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept) for r in got) == want
    assert tables() == before


def test_anti_join_reads_the_index_by_its_buckets(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_plan", 4)
    exact_dedup.exact_groups(cases.docs(spark), index=index)
    groups = exact_dedup.digests(cases.docs(spark)).groupBy("digest").count()
    plan = index.new_groups(groups)._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    right = plan[plan.index("SortMergeJoin") :].split("Scan parquet")[1]
    side = plan[: plan.index("digest_index_plan")].rsplit("\n", 6)
    assert "Bucketed: true" in right and not any("Exchange" in line for line in side[-3:])
