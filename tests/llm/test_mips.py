import numpy as np
import pytest

from tallyroom.llm import mips


def brute(ids, x, k, mod):
    out = {}
    for i, q in zip(ids, x):
        if i % mod == 0:
            score = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        hits += len({i for i, _ in best} & {r.vec_id for r in got if r.query_id == q})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("dim, hot", [(64, 0), (7, 0), (32, 700)])
def test_recall_against_brute_force(spark, dim, hot):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(2000, dim)) * rng.uniform(0.5, 2, (2000, 1))
    x[:hot] = x[0] + rng.normal(0, 0.01, (hot, dim))  # a crowd of nearly equal vectors
    ids = np.arange(2000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = mips.nearest(df, sample=1000).collect()
    want = brute(ids, x, 20, 20)
    assert recall(got, want) >= 0.95
    by = {(r.query_id, r.rank): r for r in got}
    assert len(by) == len(got) == 100 * 20
    for (q, rank), r in by.items():
        assert r.score == pytest.approx(float(x[q] @ x[r.vec_id]), abs=1e-9) and r.vec_id != q
        if rank > 1:
            before = by[q, rank - 1]
            assert (-before.score, before.vec_id) < (-r.score, r.vec_id)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(0) for n in ("score", "rank", "v", "part", "query_id")})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mips.nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 2, -0.5)]
    assert mips.nearest(df.limit(0)).count() == 0


def test_loss_weighs_parallel_residuals():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    q = mips.fit(x)
    parts, unit = q.split(x), mips._directions(q.split(x))
    def parallel(codes):
        r = np.stack([parts[k] - q.codebooks[k][codes[k]] for k in range(len(codes))])
        return ((r * unit).sum(axis=(0, 2)) ** 2).mean()
    assert parallel(mips.assign(parts, q.codebooks, 20.0)) < parallel(mips.assign(parts, q.codebooks, 1.0))
    codes = q.encode(x[:50])
    table = q.tables(x[:3])
    score = sum(table[1][m].take(c) for m, c in enumerate(q.pack(codes)))
    seen = np.concatenate([q.codebooks[k][codes[k]] for k in range(len(codes))], axis=1)
    assert np.allclose(score, seen @ x[1], atol=1e-4)
