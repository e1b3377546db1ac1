import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyroom.llm import blocks, suffix_tree
from tests.llm import cases

END, START = "</s>", "<s>"


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows):
    """The same model with dictionaries of whole word sequences."""
    docs = [(i, tokens(t)) for i, t in ((r[0], r[1]) for r in rows)]
    grams = Counter()
    for i, w in docs:
        if not is_held(i):
            s = [START, *w]
            for k in range(1, len(s)):
                for d in range(suffix_tree.DEPTH + 1):
                    if k - d >= 0:
                        grams[tuple(s[k - d : k + 1])] += 1
    unigrams = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(unigrams.values()), len(unigrams)
    n_docs = sum(not is_held(i) for i, _ in docs)
    strength, tested = {}, set()

    def seen(c):
        """How often training texts have the context, as far as shorter contexts tell: 0 if none of them was lengthened so far."""
        if len(c) == 1:
            return n_docs if c == (START,) else grams[c]
        if c[:-1] in tested:
            return grams[c]
        return seen(c[:-1]) if any(c[-d - 1 : -1] in tested and grams[c[-d - 1 :]] == seen(c[-d - 1 : -1]) for d in range(1, len(c) - 1)) else 0

    def p(context, word, depth, out):
        q = (max(unigrams.get(word, 0) - out, 0) + 0.5) / (n - out + 0.5 * (v + 1))
        for d in range(1, depth + 1):
            c = context[-d:]
            if len(c) == d and strength.get(c):
                q = (max(grams[(*c, word)] - out, 0) + strength[c] * q) / (seen(c) - out + strength[c])
        return q

    follows = defaultdict(Counter)
    for g, c in grams.items():
        follows[g[:-1]][g[-1]] = c
    sure = lambda c: max(follows[c].values(), default=0) == seen(c) > 0
    for depth in range(1, suffix_tree.DEPTH + 1):
        sums = defaultdict(lambda: np.zeros(len(suffix_tree.STRENGTHS)))
        for i, w in docs:
            if is_held(i):
                continue
            s = [START, *w]
            for k in range(1, len(s)):
                c = tuple(s[k - depth : k]) if k >= depth else None
                if c and seen(c) >= suffix_tree.LEAST and (depth == 1 or c[1:] in strength and not sure(c[1:])):
                    tested.add(c)
                    q = p(tuple(s[:k]), s[k], depth - 1, 1)
                    for j, m in enumerate(suffix_tree.STRENGTHS):
                        sums[c][j] += math.log((grams[(*c, s[k])] - 1 + m * q) / (seen(c) - 1 + m) / q)
        for c, x in sums.items():
            if x.max() > suffix_tree.MARGIN:
                strength[c] = suffix_tree.STRENGTHS[x.argmax()]
    out = []
    for i, w in docs:
        s = [START, *w]
        base = sum(math.log10((unigrams.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        own = sum(math.log10(p(tuple(s[:k]), s[k], suffix_tree.DEPTH, 0)) for k in range(1, len(s)))
        out.append((i, is_held(i), len(w), sum(x in unigrams for x in w), n, base, own))
    return out, strength


@pytest.mark.parametrize(("block_bytes", "hot"), [(2500, 1 << 18), (8_000_000, 1 << 18), (2500, 40)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, hot):
    """With many blocks in a partition, documents larger than a block, and contexts dealt over all buckets."""
    monkeypatch.setattr(suffix_tree, "HOT_LEAST", hot)
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice(["a", "b", "c", "The", "of", "x1", "x2"], 12)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(lines, int(rng.integers(0, 6)))) + " z" * int(rng.integers(0, 3)), "", "") for i in range(150)]
    rows += cases.ROWS
    want, strength = brute(rows)
    assert {len(c) for c in strength} == {1, 2, 3}
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    docs = cases.docs(spark, rows)
    assert blocks.build(docs.coalesce(1), "doc_id", "text", block_bytes).count() == (1 if block_bytes > 10**6 else pytest.approx(60, abs=50))
    got = sorted((tuple(r) for r in suffix_tree.score(docs, block_bytes=block_bytes).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5), (g, w)


def test_documents_that_occur_twice_stand_out(spark):
    """A text whose copy is held out is far likelier than one like it that is not."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60, p=np.arange(400, 0, -1) / 80_200)) for _ in range(300)]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(1000 + i, t, "", "") for i, t in enumerate(texts[:40])]
    got = {r.doc_id: r for r in suffix_tree.score(cases.docs(spark, rows)).collect()}
    twice = [r.score for i, r in got.items() if i >= 1000 and r.held_out and not is_held(i - 1000)]
    once = [r.score for i, r in got.items() if 40 <= i < 1000 and r.held_out]
    assert twice and once and min(twice) > max(once)


def test_given_documents_equal_brute_force(spark, sf):
    """Held-out texts too have words that occur once: their contexts and counts come from other blocks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: tuple(r) for r in suffix_tree.score(docs, block_bytes=60_000).collect()}
    for w in want:
        assert got[w[0]][:5] == w[:5] and got[w[0]][5:] == pytest.approx(w[5:], rel=1e-5), (got[w[0]], w)


def test_numbers_of_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 3000), rng.integers(0, 70, 3000)
    for n_a, n_b in ((50, 70), (2**31, 2**31)):  # the latter has no room for places
        number, first = suffix_tree.dense(a, n_a, b, n_b)
        pairs = sorted(set(zip(a.tolist(), b.tolist())))
        assert [pairs[k] for k in number] == list(zip(a.tolist(), b.tolist())) and [(a[i], b[i]) for i in first] == pairs


def test_odd_tables(spark):
    assert suffix_tree.score(cases.docs(spark, [])).count() == 0
    assert suffix_tree.score(cases.docs(spark)).count() == len(cases.ROWS)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf):
    rows = suffix_tree.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_context_is_too_rare(spark, monkeypatch):
    """Equals the tree that tests every context, however seldom it was seen."""
    rng = np.random.default_rng(5)
    passages = [" ".join(rng.choice([f"w{i}" for i in range(60)], 15)) for _ in range(12)]
    rows = [(i, f"{passages[i % 12]} t{i} {passages[i * 5 % 12]}", "", "") for i in range(30)]
    monkeypatch.setattr(suffix_tree, "LEAST", 1)
    want, strength = brute(rows)
    monkeypatch.undo()
    seen = Counter(c for i, w in ((i, tokens(t)) for i, t, *_ in rows) if not is_held(i) for s in [[START, *w]] for k in range(2, len(s)) for c in [tuple(s[k - 2 : k])])
    assert any(seen[c] in (2, 3) for c in strength)
    got = sorted(tuple(r) for r in suffix_tree.score(cases.docs(spark, rows).coalesce(1)).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6), (g, w)


@pytest.mark.parametrize(("held_text", "singles"), [("b x", 0), ("b u1", 1)])
def test_only_single_words_that_held_out_texts_have_are_sent(held_text, singles):
    """Words go by small numbers; a training text's single word goes only if some held-out text has that word."""
    train, held = (next(i for i in range(99) if is_held(i) == h) for h in (False, True))
    rows = []
    for k, (i, text) in enumerate([(train, "b c b c b u1 b u2"), (held, held_text)]):
        words = np.array([blocks.xxhash.xxh64_intdigest(w) for w in text.encode().split()], np.uint64)
        rows += blocks._block(k, [i], [words]).to_pylist()
    asked = blocks.pa.Table.from_batches([suffix_tree.Positions(dict(r), None, None, 1).ask_words() for r in rows])
    answers = suffix_tree._add_up_words(1)(asked)
    mine = answers.filter(blocks.pc.equal(answers["block"], 0))
    at = suffix_tree.Positions(dict(rows[0]), mine, suffix_tree.Stats(9, 5, 1), 1)
    at.read(0, 1)
    assert at.entries.single.sum() == singles
    assert set(at.numbers.tolist()) == set(range(5))


def test_contexts_of_two_words_go_by_numbers():
    """Two numbers take less room than a hash, and come back as they were, in any order; numbers without room for a pair are hashed."""
    rng = np.random.default_rng(4)
    stats = suffix_tree.Stats(9, 5, 1, 4_000_000)
    first, second = (np.minimum(rng.zipf(1.3, 2000), 3_999_999).astype(np.uint64) for _ in range(2))
    keys = np.unique(stats.longer(2, first, second))
    for order in (np.arange(len(keys)), rng.permutation(len(keys))):
        assert stats.unpack(2, stats.pack(2, keys[order])).tolist() == keys[order].tolist()
    assert len(stats.pack(2, keys)) < 0.6 * len(blocks.pack_keys(np.sort(np.array([blocks.xxhash.xxh64_intdigest(k.tobytes()) for k in keys], np.uint64))))
    wide = suffix_tree.Stats(9, 5, 1, 2**33)
    assert not wide.paired(2) and len(np.unique(wide.longer(2, first, second))) == len(keys)


def test_answers_are_shuffled_once(spark):
    """Blocks and the answers of all depths lie together: bringing them together shuffles nothing."""
    rows = spark.range(40).selectExpr("id % 7 AS block", "id AS x")
    with blocks.bucketed(rows, 8, "t") as table, blocks.appendable(spark, 8, "t") as answers:
        for _ in range(3):
            answers.append(rows)
        both = table.groupBy("block").cogroup(answers.table().groupBy("block"))
        got = both.applyInArrow(lambda a, b: a.slice(0, 1).set_column(1, "x", blocks.pa.array([len(b)])), "block long, x long")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sum(r.x for r in got.collect()) == 120
