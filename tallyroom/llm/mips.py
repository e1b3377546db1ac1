"""Maximum inner product search: anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import fan_out

CENTERS = 16  # four bits
SAMPLE = 8_192
BLOCK_BYTES = 8_000_000


@dataclass
class Quantiser:
    """Codebooks of SUBSPACES x 16 centres, and how far a table score may be from the product it stands for."""

    codebooks: np.ndarray  # subspaces x 16 x width
    slack: float

    @property
    def width(self) -> int:
        return self.codebooks.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Subspaces x rows x width; the last subspace is filled up with zeros."""
        m, _, w = self.codebooks.shape
        wide = np.zeros((len(x), m * w))
        wide[:, : x.shape[1]] = x
        return np.ascontiguousarray(wide.reshape(len(x), m, w).transpose(1, 0, 2))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return assign(self.split(x), self.codebooks, weights(x.shape[1]))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte: half as many rows."""
        if len(codes) % 2:
            codes = np.concatenate([codes, np.zeros((1, codes.shape[1]), codes.dtype)])
        return (codes[0::2] << 4 | codes[1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces, what each of 256 bytes adds to its score."""
        lut = np.einsum("mrw,mcw->rmc", self.split(q), self.codebooks)
        if lut.shape[1] % 2:
            lut = np.concatenate([lut, np.zeros((len(q), 1, CENTERS))], axis=1)
        return (lut[:, 0::2, :, None] + lut[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def weights(dim: int, threshold: float = 0.2) -> float:
    """How much more the residual's part along the vector costs than the rest, for products of threshold times the norms and up."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _directions(parts: np.ndarray) -> np.ndarray:
    norm = np.sqrt((parts**2).sum(axis=(0, 2)))
    return parts / np.where(norm > 0, norm, 1)[None, :, None]


def assign(parts: np.ndarray, codebooks: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes that minimise |r|^2 + (eta - 1) <r, x/|x|>^2 by coordinate descent over the subspaces; subspaces x rows."""
    m, n, _ = parts.shape
    unit = _directions(parts)
    square = [((parts[k][:, None, :] - codebooks[k][None]) ** 2).sum(2) for k in range(m)]
    along = [(parts[k] * unit[k]).sum(1)[:, None] - unit[k] @ codebooks[k].T for k in range(m)]
    codes = np.stack([s.argmin(1) for s in square])
    rows = np.arange(n)
    total = sum(along[k][rows, codes[k]] for k in range(m))
    for _ in range(sweeps):
        for k in range(m):
            rest = total - along[k][rows, codes[k]]
            codes[k] = (square[k] + (eta - 1) * (rest[:, None] + along[k]) ** 2).argmin(1)
            total = rest + along[k][rows, codes[k]]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, width: int = 2, rounds: int = 8, seed: int = 0) -> Quantiser:
    """Alternates assignment with the least-squares centres of the same anisotropic loss, then measures table scores' errors."""
    rng = np.random.default_rng(seed)
    m = -(-sample.shape[1] // width)
    q = Quantiser(np.zeros((m, CENTERS, width)), 0.0)
    parts = q.split(sample)
    n = len(sample)
    start = rng.choice(n, CENTERS, replace=n < CENTERS)
    q.codebooks = parts[:, start, :] + rng.normal(0, 1e-6, (m, CENTERS, width))
    eta = weights(sample.shape[1])
    unit = _directions(parts)
    for turn in range(rounds):
        e = 1.0 if turn < rounds // 2 else eta  # plain k-means first
        codes = assign(parts, q.codebooks, e, 1)
        rows = np.arange(n)
        residual = np.stack([parts[k] - q.codebooks[k][codes[k]] for k in range(m)])
        total = (residual * unit).sum(axis=(0, 2))
        for k in range(m):
            rest = total - (residual[k] * unit[k]).sum(1) + (parts[k] * unit[k]).sum(1)
            for c in range(CENTERS):
                of = rows[codes[k] == c]
                if not len(of):
                    q.codebooks[k][c] = parts[k][rng.integers(n)]
                    continue
                u = unit[k][of]
                a = len(of) * np.eye(width) + (e - 1) * u.T @ u
                b = parts[k][of].sum(0) + (e - 1) * u.T @ rest[of]
                q.codebooks[k][c] = np.linalg.solve(a, b)
    q.slack = _slack(q, sample, rng)
    return q


def _slack(q: Quantiser, sample: np.ndarray, rng) -> float:
    """The 99th percentile of the error of table scores, over each sampled query's largest products, per unit of the query's norm."""
    queries = sample[rng.choice(len(sample), min(256, len(sample)), replace=False)]
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    exact = queries @ sample.T
    codes = q.encode(sample)
    seen = np.concatenate([q.codebooks[k][codes[k]] for k in range(len(codes))], axis=1)[:, : sample.shape[1]]
    error = np.abs(queries @ seen.T - exact) / norms
    top = np.argsort(-exact, axis=1)[:, : min(32, len(sample))]
    return float(np.quantile(np.take_along_axis(error, top, 1), 0.99))


def scan(q: Quantiser, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of a block of rows, by exact products.

    The table scan gives every row a score. Rows within twice the slack of the k-th best score can still be
    among the k best: those, however many, are reranked.
    """
    packed = [c.astype(np.intp) for c in q.pack(q.encode(x))]
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        tables, norms = q.tables(some), np.linalg.norm(some, axis=1)
        for query_id, vector, table, norm in zip(query_ids[at : at + 64].tolist(), some, tables, norms.tolist(), strict=True):
            score = table[0].take(packed[0])
            for t, c in zip(table[1:], packed[1:], strict=True):
                score += t.take(c)
            score[ids == query_id] = -np.inf
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                near = np.flatnonzero((score >= least - 2 * q.slack * norm) & (score > -np.inf))
            else:
                near = np.flatnonzero(score > -np.inf)
            exact = (x[near] * vector).sum(1)
            best = near[np.lexsort((ids[near], -exact))[:k]]
            yield query_id, ids[best], (x[best] * vector).sum(1)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, dim)


def _search(q: Quantiser, dim: int, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            ids, query_ids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            for query_id, best, score in scan(q, ids, _matrix(rows["v"], dim), query_ids, _matrix(queries["v"], dim), k):
                out["query_id"].append(np.full(len(best), query_id))
                out["vec_id"].append(best)
                out["score"].append(score)
        flat = {n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "score" else np.int64) for n, v in out.items()}
        return pa.table({"query_id": pa.array(flat["query_id"], pa.int64()), "vec_id": pa.array(flat["vec_id"], pa.int64()), "score": pa.array(flat["score"], pa.float64())})

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest(vectors: DataFrame, k: int = 20, query_mod: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id is divisible by query_mod, the k rows with the largest inner product.

    Candidates are all other rows; fewer than k give all. Scores are exact products in double precision, ties go
    to the smaller id. Rows without an id, vectors that are null, empty or zero, that hold null or non-finite components, or
    that have another length than most take no part. Repeated rows are one. Extra columns are not read.

    The quantiser is fitted on the sample rows with the smallest id hashes; all rows are scanned. Rows and queries
    meet in blocks of bounded size, dealt out by hash, so that no block grows with the table or with a hot id; a block
    returns k rows per query.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()  # sample rows at most
    quantiser = fit(np.array([r.v for r in picked], np.float64))

    per_block = max(k, BLOCK_BYTES // (8 * dim))
    parts = max(min(fan_out(vectors), -(-n // 512)), -(-n // per_block))
    query_parts = max(1, -(-n // (query_mod * per_block)))
    spread = F.xxhash64("vec_id", "v")
    candidates = rows.select(
        "vec_id", "v", F.pmod(spread, F.lit(parts)).alias("part"), F.explode(_numbers(query_parts)).alias("query_part")
    )
    queries = rows.where(F.pmod("vec_id", F.lit(query_mod)) == 0).select(
        F.col("vec_id").alias("query_id"), "v", F.explode(_numbers(parts)).alias("part"), F.pmod(spread, F.lit(query_parts)).alias("query_part")
    )
    found = candidates.groupBy("part", "query_part").cogroup(queries.groupBy("part", "query_part")).applyInArrow(_search(quantiser, dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
