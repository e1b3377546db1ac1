import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import collocations as co
from tallyroom.llm import queries
from tests.compare import compare, connect
from tests.llm.cases import docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in often.items():
            for s in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                inside[s] = max(inside.get(s, 0), a)
        best = []
        for p, a in often.items():
            if 100 * inside.get(p, 0) < covered * a:
                score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sentences(seed, n, words):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(1, 40))).replace("w3 w4", "w3. w4") for _ in range(n)]


@pytest.mark.parametrize("least, top", [(3, 2000), (20, 7)])
def test_against_brute_force(spark, least, top):
    words = [f"w{i}" for i in range(60)] + ["É", "new", "New", "york", "x\x1cy", "中文"]
    rows = [(t, lang) for seed, lang in enumerate(["en", None, "und", "fr"]) for t in sentences(seed, 150, words)]
    rows += [("New York city hall! new YORK city hall,new york\tcity  hall", "en")] * 25 + [("a a a a a a a", "en")] * 9
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert rows_of(co.collocations(df, least, top)) == brute(rows, least, top)


def test_small_filters_and_summaries_change_nothing(spark, monkeypatch):
    """A bitmap that lets nearly everything through, many rows per bucket, and summaries that lose counters."""
    rows = [(t, "en") for t in sentences(7, 400, [f"w{i}" for i in range(300)])]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    monkeypatch.setattr(co, "ROW_KEYS", 16)
    monkeypatch.setattr(co, "FILTER_BITS_PER_KEY", 1)
    assert rows_of(co.collocations(df, 12)) == brute(rows, 12)


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    stream = rng.zipf(1.3, 200_000) % 50_000
    stream = np.concatenate([stream, rng.permutation(np.repeat(np.arange(60_000, 60_040), 100))]).astype(np.uint64)
    rng.shuffle(stream)
    least = 100
    capacity = len(stream) // least + 1
    true = dict(zip(*map(np.ndarray.tolist, np.unique(stream, return_counts=True))))
    often = {k for k, c in true.items() if c >= least}

    def summary(parts):
        s = co.Summary(capacity)
        for part in parts:
            s.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint64, np.int64))))
            s.settle()
            assert len(s.keys) <= capacity
        return s

    parts = np.array_split(stream, 40)
    s = summary(parts)
    assert s.error < least and s.error * (capacity + 1) <= len(stream)
    assert often <= set(s.survivors(least).tolist())
    for k, c in zip(s.keys.tolist(), s.counts.tolist()):
        assert c <= true[k] <= c + s.error
    a, b = summary(parts[:25]), summary(parts[25:])
    a.merge(b)
    assert len(a.keys) <= capacity and a.error < least and often <= set(a.survivors(least).tolist())


def test_words_are_whole_across_chunks():
    texts = [b"Alpha beta,gamma" * 50, b"", b"x" * 300, b"\xc3\xa9 \t?a"]
    want = [w for t in texts for w in (re.sub(rb"([.,;:!?\x0a-\x0d])", rb" . ", t.lower()) + b" . ").split()][:-1]
    for chunk in (1, 7, 64, 10_000):
        got = [w for _, words in co.word_stream(texts, chunk) for w in words]
        assert got == want


def test_odd_rows(spark):
    df = docs(spark).withColumns({n: F.lit("clash") for n in ("key", "f", "a", "l", "r", "phrase", "bucket", "kind")})
    rows = [(r.text, r.lang) for r in df.collect()]
    assert rows_of(co.collocations(df, 2)) == brute(rows, 2)
    assert co.collocations(df.limit(0)).count() == 0
    assert co.collocations(df.where("doc_id = 3")).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), queries.op11_collocations, queries.ORACLE_SQL["op11_collocations"], sf) > 200
