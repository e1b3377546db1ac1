"""Bounded samples of labelled rows, and calibration of raw scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import crc_mod


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows to learn from: crc32(id as text) mod modulus is not held_out, the label is 0 or 1.

    Documents with several rows count as 1 if one of them does.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col(id_col), modulus) != held_out))
    return rows.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def bounded_sample(rows: DataFrame, limit: int) -> DataFrame:
    """The limit rows with the smallest id hashes, as a table of its own small enough to broadcast."""
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return rows.sparkSession.createDataFrame([tuple(r) for r in picked], rows.schema)


class Calibration:
    """Isotonic regression of labels on raw scores by pooling adjacent violators, each pool smoothed towards the base rate."""

    def __init__(self, raw: np.ndarray, label: np.ndarray, prior: float = 0.5):
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # positives, rows, sum of raw scores
        for x, y in zip(np.asarray(raw, float)[order].tolist(), np.asarray(label, float)[order].tolist(), strict=True):
            pools.append([y, 1.0, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools]) if pools else np.array([0.0])
        self.y = np.array([(p[0] + prior) / (p[1] + 2 * prior) for p in pools]) if pools else np.array([0.5])
        self.y = np.maximum.accumulate(self.y)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)
