"""Exact top-k by inner product of quantised vectors: a KD-tree per shard, best-first search, a propagated k-th score."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, fan_out

LEAF_ROWS = 256
SHARD_BYTES = 8_000_000  # of the points that one task holds as a tree
LEAST_SHARD_ROWS = 2_048
EXACT = 2**53  # whole numbers below it are exact as doubles
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def split(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[int, np.ndarray]:
    """Leaves of a KD-tree by heap number (the root is 1, a node's children are 2i and 2i + 1): the rows of each.

    A node is cut at the median of the widest side of its tight box. Equal points are cut by position, so that both
    halves stay equal in size whatever the ties.
    """
    leaves, open_ = {}, [(1, np.arange(len(points)))]
    while open_:
        node, rows = open_.pop()
        if len(rows) <= leaf_rows:
            leaves[node] = rows
            continue
        part = points[rows]
        side = part[:, np.argmax(part.max(0).astype(float) - part.min(0).astype(float))]
        order, half = np.argpartition(side, len(rows) // 2), len(rows) // 2
        open_ += [(2 * node, rows[order[:half]]), (2 * node + 1, rows[order[half:]])]
    return leaves


@dataclass
class Tree:
    """Leaves by heap number, and the tight box of every node: those of inner nodes are joined from their leaves'."""

    ids: dict[int, np.ndarray]
    points: dict[int, np.ndarray]
    nodes: list[int]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, leaves: dict[int, tuple[np.ndarray, np.ndarray]]) -> Tree:
        box = {n: (x.min(0), x.max(0)) for n, (_, x) in leaves.items()}
        for node in sorted(leaves, reverse=True):
            while node > 1:
                low, high = box[node]
                up = box.get(node // 2, (low, high))
                box[node // 2] = (np.minimum(low, up[0]), np.maximum(high, up[1]))
                node //= 2
        nodes = sorted(box)
        return cls({n: i for n, (i, _) in leaves.items()}, {n: x for n, (_, x) in leaves.items()}, nodes, np.stack([box[n][0] for n in nodes]), np.stack([box[n][1] for n in nodes]))

    def largest(self) -> int:
        return max(abs(int(self.low.min())), abs(int(self.high.max())))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest scores, ties to the smaller id, in this order."""
    if scores.dtype == object:
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, least: list[int | None], k: int):
    """Per query (id, ids, scores): the k rows of the tree with the largest products, but none below least.

    A box bounds the product from above: each component's larger product with its two ends. The node with the highest
    bound is opened first; once no bound reaches the k-th score, or the least that the caller knows, the query ends.
    Nodes whose bound equals that score are still opened, since ties go to the smaller id.
    """
    if not len(queries):
        return
    largest = tree.largest() * max(abs(int(queries.min())), abs(int(queries.max()))) * queries.shape[1]
    kind = np.float64 if largest < EXACT else object  # past that, Python's whole numbers
    low, high, q = tree.low.astype(kind), tree.high.astype(kind), queries.astype(kind)
    points = {n: x.astype(kind) for n, x in tree.points.items()}
    held = (lambda s: np.minimum(np.maximum(s, LONG_MIN), LONG_MAX)) if kind is object else (lambda s: s)
    bounds = held(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
    at = {n: i for i, n in enumerate(tree.nodes)}
    for own, vector, bound, floor in zip(query_ids.tolist(), q, bounds.tolist(), least, strict=True):
        scores, ids = np.zeros(0, kind), np.zeros(0, np.int64)
        kth, heap = floor, [(-bound[at[1]], 1)]
        while heap:
            top, node = heapq.heappop(heap)
            if kth is not None and -top < kth:
                break
            if node not in points:
                for child in (2 * node, 2 * node + 1):
                    b = bound[at[child]]
                    if kth is None or b >= kth:
                        heapq.heappush(heap, (-b, child))
                continue
            s, i = held(points[node] @ vector), tree.ids[node]
            good = i != own if kth is None else (i != own) & (s >= kth).astype(bool)
            if not good.any():
                continue
            scores, ids = _best(np.concatenate([scores, s[good]]), np.concatenate([ids, i[good]]), k)
            if len(ids) == k:
                kth = scores[-1] if floor is None else max(floor, scores[-1])
        yield own, ids, scores


LEAF = "shard int, node long, ids binary, points binary"


def _build(dim: int, leaf_rows: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        points = np.asarray(rows["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim)
        leaves = split(points, leaf_rows)
        return pa.table(
            {
                "shard": pa.array([rows["shard"][0].as_py()] * len(leaves), pa.int32()),
                "node": pa.array(list(leaves), pa.int64()),
                "ids": pa.array([ids[r].tobytes() for r in leaves.values()], pa.binary()),
                "points": pa.array([points[r].tobytes() for r in leaves.values()], pa.binary()),
            }
        )

    return run


FOUND = "query_id long, vec_id long, score long"


def _search(dim: int, k: int):
    def run(leaves: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if leaves.num_rows and queries.num_rows:
            held = {n: (np.frombuffer(i, np.int64), np.frombuffer(p, np.int64).reshape(-1, dim)) for n, i, p in zip(*(leaves[c].to_pylist() for c in ("node", "ids", "points")), strict=True)}
            q = np.asarray(queries["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim)
            for own, ids, scores in search(Tree.of(held), queries["query_id"].to_numpy(), q, queries["least"].to_pylist(), k):
                out[0].append(np.full(len(ids), own, np.int64))
                out[1].append(ids)
                out[2].append(scores.astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 20, query_mod: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id is divisible by query_mod, the k rows with the largest inner product. Exact.

    Components count as floor(scale * x), x as double; candidates are all other rows; fewer than k give all; ties go to the smaller
    id. Rows without an id and vectors that are null, empty, hold null or non-finite components, or have another length
    than most take no part; zero vectors do. Repeated rows are one; of several different vectors under one id the largest
    in array order stands. Components and scores beyond a long count as its ends. Extra columns are not read.

    Rows go by hash to shards of bounded size, each a KD-tree, kept in the shared folder as one row per leaf. A query
    first searches its own shard; the k-th score found there goes with it to the others, which return only what reaches
    it. All queries meet all shards in blocks of both.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kd")
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    rows = scratch.keep(rows.groupBy("vec_id").agg(F.max("v").alias("v")), "rows")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    per_shard = max(k + 1, shard_bytes // (8 * dim))
    shards = max(min(fan_out(vectors), -(-n // LEAST_SHARD_ROWS)), -(-n // per_shard))
    query_parts = max(1, -(-n // (query_mod * per_shard)))
    hashed = F.xxhash64("vec_id")
    rows = rows.where(F.size("v") == dim).withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int"))
    leaves = scratch.keep(rows.groupBy("shard").applyInArrow(_build(dim, leaf_rows), LEAF), "leaves")

    asks = rows.where(F.pmod("vec_id", F.lit(query_mod)) == 0).select(F.col("vec_id").alias("query_id"), "v", F.col("shard").alias("home"))
    first = asks.select("query_id", "v", F.lit(None).cast("long").alias("least"), F.col("home").alias("shard"))
    home = scratch.keep(leaves.groupBy("shard").cogroup(first.groupBy("shard")).applyInArrow(_search(dim, k), FOUND), "home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_parts)).cast("int").alias("part")
    rest = asks.join(kth, "query_id", "left").select("query_id", "v", "least", part, "home", every(shards).alias("shard")).where("shard <> home").drop("home")
    trees = leaves.withColumn("part", every(query_parts))
    other = trees.groupBy("shard", "part").cogroup(rest.groupBy("shard", "part")).applyInArrow(_search(dim, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(other).select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
