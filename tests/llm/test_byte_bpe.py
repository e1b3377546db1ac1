import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import byte_bpe
from tests.llm import cases


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_path()), special_tokens={})
    return e.encode_ordinary


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(byte_bpe.default_path(), byte_bpe.default_pattern())


def test_queue_gives_lowest_rank_then_leftmost():
    rng = np.random.default_rng(2)
    queue, rest = byte_bpe.RankQueue(60_000), {}
    pop = lambda: (min(rest), sorted(rest.pop(min(rest))))
    for _ in range(3000):
        if rest and rng.random() < 0.45:
            rank, positions = queue.pop()
            assert (rank, positions.tolist()) == pop()
        else:
            n = int(rng.integers(0, 6))
            ranks, positions = rng.integers(0, 60_000 if rng.random() < 0.5 else 5, n), rng.integers(0, 1000, n)
            queue.push_all(ranks, positions)
            for r, p in zip(ranks.tolist(), positions.tolist()):
                rest.setdefault(r, []).append(p)
    while rest:
        rank, positions = queue.pop()
        assert (rank, positions.tolist()) == pop()
    assert queue.pop() is None


def test_ranks_that_fall_below_the_current_one(tmp_path):
    """'abc' ranks before 'ab' though only 'ab' can lead to it: the next merge is the lowest anywhere in the piece."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"abcab": 258, b"ca": 259, b"aba": 260}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = byte_bpe.ByteBpe(str(path), byte_bpe.default_pattern())
    library = tiktoken.Encoding("odd", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abc"), int(rng.integers(1, 40)))) for _ in range(500)]
    got = own.merge([p.encode() for p in pieces])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(p) for p in pieces]


def test_entries_survive_generations(bpe, monkeypatch):
    known = byte_bpe.Remembered(3)
    for i in range(20):
        known.put(str(i), b"%d" % i)
        assert known.get("0") == b"0"  # used, so it moves on
    assert known.get("5") is None


def test_equals_library(bpe, library):
    rng = np.random.default_rng(3)
    letters = list("aB éß’s.,!-_#́ \x1c\x1f\x85　\t\r\nñ12٣中あ🙂") + ["  ", "   ", " \n", "'ll", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(6000)] + [r[1] for r in cases.ROWS]
    ids, sizes = bpe.encode_batch(pa.array(texts))
    ends = np.cumsum(sizes)
    decoded = bpe.decode(ids, sizes)
    for text, size, end, back in zip(texts, sizes, ends, decoded):
        assert ids[end - size : end].tolist() == library(text or ""), repr(text)
        assert bytes(back) == (text or "").encode()


def test_random_bytes_merge_as_the_library(bpe, library):
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 50, 5000):
        piece = "".join(rng.choice(list("aeinrst"), size))
        assert np.frombuffer(bpe.merge([piece.encode()])[0], "<u4").tolist() == library(piece)
        assert bpe.merge([piece.encode()], exact=True) == bpe.merge([piece.encode()])
    assert np.frombuffer(bpe.merge([b"a" * 10_001])[0], "<u4").tolist() == library("a" * 10_001)


def test_query_rows(spark, library):
    got = byte_bpe.encode(cases.docs(spark), keep_ids=True).collect()
    want = []
    for doc_id, text, *_ in cases.ROWS:
        ids = library(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    key = lambda r: (r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(cases.docs(spark, [])).count() == 0
