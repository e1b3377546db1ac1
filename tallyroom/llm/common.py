"""Scratch tables in the shared folder, hashing, and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tallyroom-")
    return _LOCAL["dir"]


#: Spark's setting (4.1) by which a query's shuffle files go at its end, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside delete their shuffle files as they end. The session's own setting holds again afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Parquet tables of one run in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
        """Writes df and reads it back. What the write shuffled is gone then: nothing reads it again."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        with shuffle_files_go(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        reader = self.spark.read.schema(df.schema)
        out = reader.parquet(path)
        out._scratch_path = path
        self._tables.append(out)
        return out

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a result, reads it back, and deletes all other tables of the run."""
        out = self.keep(df, name)
        self.drop(*(t for t in self._tables if t is not out))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of which no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self._tables = [x for x in self._tables if x is not t]


def rows_by_id(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids of a one-column table; null ids match each other. No column of docs can clash."""
    name = f"_id_{uuid.uuid4().hex}"
    ids = ids.toDF(name).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[name]), how)


#: A group that more than one in so many rows belong to is joined apart: there are no more such groups than this.
HOT_SHARE = 8_192


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows with their groups' columns (null where there is none); size: the column of groups that counts their rows, of total.

    Both sides meet by a sort-merge join on the key, but for groups of over 1 / HOT_SHARE of all rows, which would
    bring these to one task: there are at most HOT_SHARE, and those are broadcast.
    """
    is_hot = F.col(size) * HOT_SHARE > total
    hot, usual = groups.where(is_hot), groups.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(usual.hint("merge"), on, "left"))


def input_partitions(df: DataFrame) -> int:
    """Partitions of a scan; follows the input's size, as spark.sql.files.maxPartitionBytes cuts it."""
    return max(1, df.rdd.getNumPartitions())


def fan_out(df: DataFrame) -> int:
    """Partitions for shuffles that carry about as much data as df: at least as many as its scan has."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_partitions(df))


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32(id as text) mod modulus; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser for unsigned integers."""
    a = (a ^ (a >> np.uint64(30))) * _MUL2
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 64-bit key of a sequence whose first part has key left and whose next symbol has key right."""
    return mix(left * _MUL + right + np.uint64(1))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z: bytes.lower and bytes.split know ASCII alone."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct keys of the shingles of size words; a shorter text is one shingle; no words, none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    keys = mix(hashes[:n])
    for k in range(1, size):
        keys = chain(keys, hashes[k : k + n])
    return np.unique(keys)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Alternates the large-star and small-star steps, each one grouped minimum and one join, and writes each
    round to the shared folder, until the edges stay the same: then each node but the smallest of its component has
    one edge, to that. A node with a third of all edges is spread by the join's skew handling. Rounds grow with the
    logarithm of the number of nodes.
    """
    e = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(parent, "u").select(F.explode(ends).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = scratch.keep(small, "edges")
        state = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(e)
        e = new
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def slices(texts, limit: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string array with about limit bytes of text each, one row at least."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, "right")))
        yield start, end
        start = end


def release_memory() -> None:
    """Gives what a task has freed back to the system: the worker process lives on, next to its executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; strings come as their UTF-8 bytes."""
    import pyarrow as pa

    for batch in batches:
        columns = []
        for name in names:
            column = batch.column(batch.schema.get_field_index(name))
            if pa.types.is_string(column.type):
                column = column.cast(pa.binary())
            elif pa.types.is_large_string(column.type):
                column = column.cast(pa.large_binary())
            columns.append(column.to_pylist())
        yield from zip(*columns, strict=True)
