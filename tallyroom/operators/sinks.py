"""Writers: whole tables by a staged swap, keyed tables by rewriting the touched buckets alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import tables
from tallyroom.operators.scratch import Kept, delete, exists

OLD = ".before-swap"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, a: str, b: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not _files(spark, a).rename(path(a), path(b)):
        raise OSError(f"cannot rename {a} to {b}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends a swap that was cut off: without a table in place the old one comes back, with one the old one goes."""
    old = path.rstrip("/") + OLD
    if exists(spark, old):
        if exists(spark, path):
            delete(spark, old)
        else:
            _rename(spark, old, path)


def swap_table(df: DataFrame, path: str, verify: Callable[[DataFrame], None] | None = None) -> int:
    """Replaces the table at path by df and returns its number of rows; df may read the table itself.

    df is written beside, read back and counted against what the writing tasks saw; verify may raise for reasons of its own. Only then
    the two folders change places, by two renames. A failure before them leaves the old table as it is, one between them is
    mended by recover(), which every swap begins with. Renames of folders must be atomic, as on HDFS.
    """
    from pyspark.sql import Observation

    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    stage, seen = f"{path}.stage-{uuid.uuid4().hex}", Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(stage)
        staged = spark.read.schema(df.schema).parquet(stage)
        n = staged.count()
        if n != seen.get["n"]:
            raise ValueError(f"{stage} holds {n} rows of {seen.get['n']}")
        if verify:
            verify(staged)
        if exists(spark, path):
            _rename(spark, path, path + OLD)
        _rename(spark, stage, path)
    except BaseException:
        delete(spark, stage)
        recover(spark, path)
        raise
    delete(spark, path + OLD)
    return n


def bucket_of(on: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(buckets)).cast("int")


class KeyedTable:
    """A table of rows with unique keys, partitioned by the hash of the key: a write rewrites the buckets of its keys and no others."""

    def __init__(self, spark: SparkSession, path: str, schema: str, on: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.on, self.buckets = spark, path.rstrip("/"), schema, on, buckets

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: the scan is pruned to them."""
        columns = self.spark.createDataFrame([], self.schema).columns
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*columns)

    def _write(self, rows: DataFrame) -> None:
        """Rows of whole buckets, dealt out by bucket, so that a bucket is one file; files take their places when all are written."""
        placed = rows.withColumn("bucket", bucket_of(self.on, self.buckets)).repartition("bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(bucket_of(self.on, self.buckets)).distinct().collect())  # as many as there are buckets

    def upsert(self, updates: DataFrame, keep_old: tuple[str, ...] = ()) -> tuple[int, int]:
        """tables.upsert into the stored rows; how many keys were added and how many updated. Keys of updates are unique."""
        kept = Kept(self.spark, "upsert")
        updates = kept.keep(updates)
        touched = self._touched(updates)
        old = kept.keep(self.read(touched))  # what is overwritten is not read while it is written
        merged = kept.keep(tables.upsert(old, updates, self.on, keep_old))
        self._write(merged)
        n = updates.count()
        added = merged.count() - old.count()
        delete(self.spark, kept.base)
        return added, n - added

    def insert(self, rows: DataFrame, order: str = "id") -> int:
        """The first row of each key that the table doesn't have; how many there were. A second call with the same rows adds none."""
        kept = Kept(self.spark, "insert")
        rows = kept.keep(rows)
        old = kept.keep(self.read(self._touched(rows)))
        fresh = kept.keep(tables.insert_new(old, rows, self.on, order).select(*old.columns))
        n = fresh.count()
        if n:
            self._write(old.join(fresh.select(bucket_of(self.on, self.buckets).alias("_b")).distinct(), bucket_of(self.on, self.buckets) == F.col("_b"), "left_semi").unionByName(fresh))
        delete(self.spark, kept.base)
        return n
