import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import kd_search, queries
from tests.compare import compare, connect


def brute(ids, x, k, mod):
    out = []
    for i, q in zip(ids, x):
        if i % mod == 0:
            scores = [(-sum(int(a) * int(b) for a, b in zip(q, y)), int(j)) for j, y in zip(ids, x) if j != i]
            out += [(int(i), r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("dim, hot, leaf_rows", [(8, 0, 16), (3, 500, 4), (24, 0, 64)])
def test_against_brute_force(spark, dim, hot, leaf_rows):
    rng = np.random.default_rng(dim)
    x = rng.integers(-40, 40, (900, dim))
    x[:hot] = x[0]  # more equal vectors than a leaf holds, and ties everywhere
    ids = rng.permutation(5000)[:900]
    df = spark.createDataFrame([(int(i), (v / 64).tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = kd_search.top_k(df, k=7, leaf_rows=leaf_rows, shard_bytes=8 * dim * 100).collect()
    assert sorted(map(tuple, got)) == brute(ids, x, 7, 20)


def test_boxes_are_tight_and_cut_at_the_median():
    x = np.random.default_rng(1).integers(-50, 50, (1000, 5))
    leaves = kd_search.split(x, 32)
    assert sorted(np.concatenate(list(leaves.values()))) == list(range(1000))
    assert max(map(len, leaves.values())) <= 32 < 2 * min(map(len, leaves.values())) + 32
    tree = kd_search.Tree.of({n: (r, x[r]) for n, r in leaves.items()})
    root = tree.nodes.index(1)
    assert (tree.low[root] == x.min(0)).all() and (tree.high[root] == x.max(0)).all()


def test_a_known_score_leaves_boxes_shut(monkeypatch):
    """On spread clusters most leaves are never opened, and a k-th score from elsewhere opens fewer still."""
    rng = np.random.default_rng(2)
    x = (rng.integers(-1000, 1000, (64, 2))[:, None] + rng.integers(-3, 3, (64, 32, 2))).reshape(-1, 2)
    leaves = kd_search.split(x, 32)
    opened = []

    class Points(np.ndarray):
        def __matmul__(self, other):
            opened.append(1)
            return np.asarray(self) @ np.asarray(other)

    tree = kd_search.Tree.of({n: (r, x[r]) for n, r in leaves.items()})
    tree.points = {n: p.view(Points) for n, p in tree.points.items()}
    q = np.array([[500, 300]])
    (_, ids, scores), = kd_search.search(tree, np.array([-1]), q, [None], 5)
    assert sorted((x @ q[0]).tolist())[-5:] == sorted(int(s) for s in scores) and len(opened) < len(leaves) / 4
    before = len(opened)
    assert not len(next(kd_search.search(tree, np.array([-1]), q, [10**9], 5))[1]) and len(opened) == before


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 9.0]), (1, [0.5, 0.5]), (2, [-0.001, -0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit(0) for n in ("score", "rank", "v", "shard", "query_id", "least", "part", "home", "node")})
    got = sorted(map(tuple, kd_search.top_k(df).collect()))
    assert got == [(0, 1, 1, 2048), (0, 2, 3, 0), (0, 3, 20, 0), (0, 4, 2, -64), (20, 1, 1, 2048), (20, 2, 0, 0), (20, 3, 3, 0), (20, 4, 2, -2048)]
    assert kd_search.top_k(df.limit(0)).count() == 0
    assert kd_search.top_k(df.where("vec_id = 20")).count() == 0


def test_numbers_past_doubles_and_longs(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, 2.0]), (3, [-1e300, 0.0]), (4, [1e-3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in kd_search.top_k(df).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1), (3, 4, 0), (4, 3, -(2**63))]


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), queries.op12_kd_search, queries.ORACLE_SQL["op12_kd_search"], sf) == 500
