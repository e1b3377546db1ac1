"""Exact deduplication against a persistent digest index, a table bucketed and sorted by hash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, byte_rows, fan_out, join_groups, rows_by_id

DIGEST_SCHEMA = "doc_id long, digest binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for doc_id, text in byte_rows([batch], "doc_id", "text"):
            ids.append(doc_id)
            out.append(hashlib.sha256((text or b"").lower()).digest())  # bytes.lower changes A-Z alone
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SHA-256 of each text after lower-casing A-Z; null counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests, DIGEST_SCHEMA)


class DigestIndex:
    """A table of (digest, keep_id, run), bucketed and sorted by digest: one row for each text seen.

    ``add`` joins a batch's groups with the table by a sort-merge anti-join on the buckets: the table's side is neither
    shuffled nor sorted, and new digests are appended. A text's surviving row is chosen in the batch that
    brought it first; later batches lose to it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def new_groups(self, groups: DataFrame) -> DataFrame:
        """The groups whose text the index doesn't have."""
        groups = groups.repartition(self.buckets, "digest")
        if self.exists():
            groups = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def append(self, groups: DataFrame) -> None:
        writer = groups.repartition(self.buckets, "digest").write.format("parquet").option("compression", "zstd")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def add(self, hashed: DataFrame, run: str, scratch: Scratch) -> DataFrame:
        """Adds a batch of (doc_id, digest); gives its groups of equal texts: digest, keep_id (the largest id), group_size.

        The groups, and which of them are new, are written before the index changes: a task that runs again reads
        what was decided and not the index as it is by then.
        """
        groups = hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = scratch.keep(groups, "groups")
        self.append(scratch.keep(self.new_groups(groups).select("digest", "keep_id", F.lit(run).alias("run")), "new"))
        return groups


def resolve(hashed: DataFrame, index: DigestIndex, groups: DataFrame, run: str, scratch: Scratch) -> DataFrame:
    """Per document: the surviving row of its text by the index (null if an earlier run brought the text), and how many rows of this run have it."""
    sizes = groups.groupBy("digest").agg(F.sum("group_size").alias("group_size")).repartition(index.buckets, "digest")
    own = index.read().where(F.col("run") == run).select("digest", "keep_id", F.lit(True).alias("new"))
    texts = scratch.keep(sizes.join(own.hint("merge"), "digest", "left"), "texts")
    total = texts.agg(F.sum("group_size")).first()[0] or 0
    found = join_groups(hashed, texts, ["digest"], "group_size", total)
    kept = F.coalesce("new", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def batches_of(hashed: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in so many batches of about equal size, by falling doc_id; rows without an id come last."""
    cuts = hashed.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    limits = sorted(set(cuts or []), reverse=True)
    out, above = [], None
    for low in [*limits, None]:
        high_enough = F.lit(True) if low is None else F.col("doc_id") >= low
        low_enough = F.lit(True) if above is None else F.coalesce(F.col("doc_id") < above, F.lit(low is None))
        out.append(hashed.where(high_enough & low_enough))
        above = low
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null texts count as empty. Of equal texts the
    row with the largest id stays; with repeated ids, each such row is reported as kept, and a text that only rows
    without an id have keeps those. Extra columns are not
    read. An empty table gives an empty result. Documents go through the index in batches of falling id, so that the
    batch that brings a text first has the row that stays. With an index given, texts that earlier calls brought have
    keep_id null and are not kept; without, an index of this call alone is used and dropped at the end.
    """
    spark = docs.sparkSession
    # A digest takes a small part of its text: fewer buckets than the documents have partitions.
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", max(8, fan_out(docs) // 8))
    scratch, run = Scratch(spark, "digests"), uuid.uuid4().hex
    hashed = scratch.keep(digests(docs, id_col, text_col), "hashed")
    try:
        groups = [own.add(batch, run, scratch) for batch in batches_of(hashed, batches)]
        every = groups[0]
        for g in groups[1:]:
            every = every.unionByName(g)
        return scratch.finish(resolve(hashed, own, every, run, scratch), "rows")
    finally:
        if index is None:
            own.drop()


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text no row with a larger id has; all columns of docs. Rows without an id stay if one of them does."""
    return rows_by_id(docs, id_col, exact_groups(docs, id_col, text_col).where("kept").select("doc_id"), "left_semi")
