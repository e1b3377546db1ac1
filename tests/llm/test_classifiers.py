import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import quality, toxicity
from tallyroom.llm.labelled import Calibration
from tests.llm import cases


def test_calibration_is_monotone_and_near_the_rates():
    rng = np.random.default_rng(0)
    raw = rng.random(2000)
    label = rng.random(2000) < raw**2
    c = Calibration(raw, label)
    got = c(np.linspace(0, 1, 50))
    assert (np.diff(got) >= 0).all() and abs(c(np.array([0.5]))[0] - 0.25) < 0.1


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    n_terms, n = 40, 700
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(n_terms, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((n, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    ids = rng.permutation(n)
    index = toxicity.BlockMaxIndex(ids, np.zeros(n), vectors, n_terms)
    for i in range(60):
        t, w = vectors[i]
        similarity = dense @ dense[i]
        similarity[i] = -1
        want = np.lexsort((ids, -similarity))[:15]
        at, got = index.search(t, w, 15, int(ids[i]))
        assert np.allclose(np.sort(got), np.sort(similarity[want][similarity[want] > 0]))


def test_vectoriser_counts_terms():
    """All words, and those beginnings that mark a label."""
    rows, term, tf = toxicity.Vectoriser(["idio*", "scum"]).batch(pa.array(["Idiot! idiot's scum", None, "", "idiots   x"]))
    of = toxicity.term_id
    want = {(0, of("idio*"), 2), (0, of("idiot"), 2), (0, of("s"), 1), (0, of("scum"), 1), (3, of("idio*"), 1), (3, of("idiots"), 1), (3, of("x"), 1)}
    assert set(zip(rows.tolist(), term.tolist(), tf.tolist())) == want


def corpus(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        toxic, bad = int(i % 7 == 0), int(i % 5 == 1)
        text = list(rng.choice(words, rng.integers(20, 60)))
        for _ in range(3 * toxic):
            text.insert(int(rng.integers(0, len(text))), rng.choice(["vilest", "Scumbag!", "grimble"]))
        if bad:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1 - bad, toxic))
    rows += [(2000, None), (2001, ""), (2002, rows[7][1]), (2002, rows[7][1]), (None, "grimble"), (2003, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("label", "score", "terms", "tf", "x")})
    labels += [(5, None, None), (2000, 1, 0), (4, 1, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")), {i: (int(i % 7 == 0), int(i % 5 != 1)) for i in range(1200)}


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    held = [(r.predicted, truth[r.doc_id][0]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.doc_id not in r.evidence_ids for r in got)
    assert len({r.score for r in got if r.doc_id in (2000, 2001)}) == 1
    got = quality.score(docs, labels).collect()
    held = [(r.predicted, truth[r.doc_id][1]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_tables(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert module.score(cases.docs(spark), none).count() == len(cases.ROWS)
    assert module.score(cases.docs(spark, []), none).count() == 0


def test_features_of_known_texts():
    names = {n: i for i, n in enumerate(quality.FEATURES)}
    x = quality.features(pa.array(["Aa bb bb!", None, "l1\nl1\nl2"]))
    assert x.shape == (3, len(names)) and np.isfinite(x).all()
    assert x[0, names["upper"]] == pytest.approx(1 / 6) and x[0, names["distinct_words"]] == 1 and x[2, names["repeated_lines"]] == pytest.approx(1 / 3)
    assert (quality.features(pa.array(["zz", "Aa bb bb!"]).slice(1))[0] == x[0]).all()


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=30)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9 and (1, 0) in model.pairs


def test_row_with_the_smallest_id_stands_for_near_copies(spark):
    """In any order of rows; near copies are texts that share their smallest pair of words."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    pairs = [f"{word()} {word()}" for _ in range(300)]
    family = lambda text: next(toxicity._families([pa.RecordBatch.from_arrays([pa.array([x]) for x in (0, text, 1)], names=["doc_id", "text", "label"])])).column("family")[0].as_py()
    pairs = [p for p in pairs if family(f"{p} zgood") == family(f"{p} zbad")]
    texts = [(i, f"{p} zgood", 1) for i, p in enumerate(pairs)] + [(1000 + i, f"{p} zbad", 1) for i, p in enumerate(pairs)] + [(2000 + i, f"{word()} {word()}", 0) for i in range(100)]
    for rows in (texts, texts[::-1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(1)
        terms = toxicity.choose_terms(docs.drop("label"), docs.select("doc_id", "label"))
        assert "zgood" in terms and "zbad" not in terms


def dense_toxicity(docs, labels, marks):
    """The whole result by dense vectors: cosine with every example, vote of the nearest, isotonic calibration."""
    import re
    import zlib
    from collections import Counter

    train = {}
    for i, _, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2:
            train[i] = max(y, train.get(i, 0))
    bags = []
    for _, text in docs:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        bags.append(Counter(toxicity.term_id(t) for w in words for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k and w[:k] + "*" in marks)]))
    df = Counter(t for b in bags for t in b)
    marked = {toxicity.term_id(t) for t in marks}
    weight = lambda t: (np.log((1 + len(docs)) / (1 + df[t])) + 0.01) * (toxicity.MARK_WEIGHT if t in marked else 1)
    column = {t: k for k, t in enumerate(sorted(df))}
    x = np.zeros((len(docs), len(column)))
    for r, b in enumerate(bags):
        for t, n in b.items():
            x[r, column[t]] = (1 + np.log(n)) * weight(t)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    at = {i: r for r, (i, _) in reversed(list(enumerate(docs)))}
    examples = [i for i in train if i in at and bags[at[i]]]
    raw = []
    for r, (i, _) in enumerate(docs):
        near = sorted(((-float(x[r] @ x[at[e]]), e) for e in examples if e != i and x[r] @ x[at[e]] > 0))[: toxicity.NEIGHBOURS]
        w = np.array([1 / (1.02 - min(1, -s)) for s, _ in near])
        mean = np.mean([train[e] for e in examples])
        raw.append(float(((w * [train[e] for _, e in near]).sum() + mean) / (w.sum() + 1)) if near else None)
    seen = [(raw[r], train[i]) for r, (i, _) in enumerate(docs) if i in train]
    voted = [s for s in seen if s[0] is not None]
    calibrate = Calibration(np.array([s[0] for s in voted]), np.array([s[1] for s in voted]))
    rest = [y for v, y in seen if v is None] or [y for _, y in seen]
    empty = (sum(rest) + 0.5) / (len(rest) + 1)
    return [empty if v is None else float(calibrate(np.array([v]))[0]) for v in raw]


def test_toxicity_equals_dense_cosine(spark):
    """The whole result, against every example compared with every text."""
    df, labels, _ = corpus(spark)
    rows = [(r.doc_id, r.text) for r in df.where("doc_id < 400 or doc_id >= 2000 or doc_id is null").collect()]
    labelled = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(i, y) for i, _, y in labelled if i is not None and y in (0, 1) and crc(i) % 4 != 2]
    marks = toxicity.choose_terms(docs, spark.createDataFrame(train, "doc_id long, label int"))
    assert {"vilest", "scumbag", "grimble"} <= set(marks)
    want = dense_toxicity(rows, labelled, set(marks))
    key = lambda r: (r[0] is None, r[0], r[1])
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(docs, labels).collect()), key=key)
    assert len({round(s, 9) for _, s in got}) > 20
    for g, w in zip(got, sorted(((i, s) for (i, _), s in zip(rows, want)), key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-6), (g, w)


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_quality_equals_a_plain_sum_of_tables(spark):
    """The whole result: the tables of a model fitted on the same rows, looked up feature by feature and pair by pair."""
    df, labels, _ = corpus(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    x = quality.features(pa.array([t for _, t in rows]))
    learnt = sorted({i: k for k, (i, _) in reversed(list(enumerate(rows))) if i is not None and i in truth and crc(i) % 5 != 0}.items())
    model = quality.fit(x[[k for _, k in learnt]], np.array([truth[i] for i, _ in learnt], float))
    key = lambda r: (r[0] is None, r[0], r[1])
    want = []
    for (i, _), f in zip(rows, x):
        at = lambda edges, v: sum(1 for e in edges if e <= v)
        z = model.intercept + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, f))
        z += sum(t[at(model.pair_edges[a], f[a]), at(model.pair_edges[b], f[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        want.append((i, 1 / (1 + np.exp(-z))))
    got = sorted(((r.doc_id, r.score) for r in quality.score(df, labels).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-6), (g, w)


def test_rows_with_one_id_and_other_texts(spark):
    """Which text is learnt from depends on the texts alone, not on the order of rows."""
    rng = np.random.default_rng(3)
    rows = [(i % 60, " ".join(rng.choice(["aa", "bb", "cc", "vile", "DD!!"], 12))) for i in range(180)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        one, two = (sorted(map(tuple, module.score(spark.createDataFrame(r, "doc_id long, text string"), labels).select("doc_id", "score").collect())) for r in (rows, rows[::-1]))
        assert one == two
