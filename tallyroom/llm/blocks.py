"""Blocks of hashed words, and counts of keys over all blocks by one exchange of packed, sorted keys.

A job that needs the corpus-wide count of each of its keys (shingles, word sequences) would shuffle a row per
occurrence. Here a block of documents sends each distinct key once, sorted, as differences packed by byte planes,
to the bucket that the key's first bits name; the bucket adds up and answers each block with counts in the
block's own order of keys. A frequent key is one entry per block, so no bucket is hot.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import fan_out, release_memory, shuffle_files_go, slices

BLOCK_BYTES = 8_000_000
BLOCK_SCHEMA = "block long, doc_ids binary, sizes binary, words binary"
NULL_ID = -(2**63)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes: planes of zeros take next to nothing."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def spread(data: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    if not zstandard.frame_content_size(data):
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order in which they first occur, where that is, and of each key its place among these. Nothing is sorted."""
    coded = pa.array(keys).dictionary_encode()
    values, place = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    first = np.empty(len(values), np.int64)
    first[place[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return values, first, place


def _block(number: int, ids: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in words], np.uint32)
    values, _, place = distinct(np.concatenate(words))
    at = np.argsort(values)
    back = np.empty(len(at), np.int64)
    back[at] = np.arange(len(at))
    vocabulary, codes = values[at], back[place]
    counts = np.bincount(codes, minlength=len(at))
    rank = np.empty(len(counts), np.uint32)
    order = np.argsort(-counts, kind="stable")
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    packed = [pack_keys(vocabulary), squeeze(order.astype(np.uint32)), squeeze(rank[codes])]
    head = np.array([len(p) for p in packed], "<u4").tobytes()
    row = [np.array(ids, np.int64).tobytes(), sizes.tobytes(), head + b"".join(packed)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["block", "doc_ids", "sizes", "words"])


def _hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of string texts, and where each text's start; every distinct word is hashed once.

    Arrow lower-cases A-Z and splits at ASCII white space, as words_of does.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist()
    code = coded.indices.to_numpy()
    offsets = np.asarray(lists.offsets)
    full = np.fromiter(map(bool, words), bool, len(words))[code]  # white space at either end leaves an empty string
    starts = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[code[full]], starts


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, words = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            texts = batch.column(1).fill_null("")
            lengths = pc.binary_length(texts).to_numpy()
            for first, last in slices(texts):
                hashes, starts = _hashed_words(texts.slice(first, last - first))
                for k, doc_id in enumerate(batch.column(0).slice(first, last - first).fill_null(NULL_ID).to_pylist()):
                    ids.append(doc_id)
                    words.append(hashes[starts[k] : starts[k + 1]])
                    size += int(lengths[first + k]) + 64
                    if size >= block_bytes:
                        yield _block(number, ids, words)
                        number, size, ids, words = number + 1, 0, [], []
        if ids:
            yield _block(number, ids, words)
        release_memory()

    return run


def build(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of about block_bytes of text: its documents' ids (null: NULL_ID), their numbers of words, and the words' hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_blocks(block_bytes), BLOCK_SCHEMA)


@contextlib.contextmanager
def bucketed(rows: DataFrame, buckets: int, name: str) -> Iterator[DataFrame]:
    """Rows as a table bucketed by block, dropped at the end. What the write shuffled is gone before."""
    name = f"{name}_{uuid.uuid4().hex}"
    try:
        with shuffle_files_go(rows.sparkSession):
            rows.write.format("parquet").option("compression", "none").bucketBy(buckets, "block").saveAsTable(name)
        yield rows.sparkSession.table(name)
    finally:
        rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class Appended:
    """A table bucketed by block that grows: rows are shuffled once, as they are appended."""

    def __init__(self, spark: SparkSession, buckets: int, name: str):
        self.spark, self.buckets, self.name = spark, buckets, name

    def append(self, rows: DataFrame) -> None:
        with shuffle_files_go(self.spark):
            there = rows.repartition(self.buckets, "block").write.format("parquet").option("compression", "none")
            there.bucketBy(self.buckets, "block").mode("append").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)


@contextlib.contextmanager
def appendable(spark: SparkSession, buckets: int, name: str) -> Iterator[Appended]:
    name = f"{name}_{uuid.uuid4().hex}"
    try:
        yield Appended(spark, buckets, name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_place(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, name: str) -> contextlib.AbstractContextManager[DataFrame]:
    """The blocks as a table, dropped at the end. Bucketed by block, they stay where they are: only questions and answers are shuffled."""
    return bucketed(build(docs, id_col, text_col, block_bytes), fan_out(docs), name)


def unpack_coded(doc_ids: bytes, sizes: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, where each document's words start (one more than there are documents), the block's sorted distinct hashes,
    and of each word its place among these."""
    a, b, c = np.frombuffer(words, "<u4", 3).tolist()
    vocabulary, order = unpack_keys(words[12 : 12 + a]), spread(words[12 + a : 12 + a + b], np.uint32)
    codes = spread(words[12 + a + b : 12 + a + b + c], np.uint32)
    return np.frombuffer(doc_ids, np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)]), vocabulary, order.astype(np.int64)[codes]


def unpack(doc_ids: bytes, sizes: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, where each document's words start, and the words' hashes."""
    ids, starts, vocabulary, code = unpack_coded(doc_ids, sizes, words)
    return ids, starts, vocabulary[code]


def bucket_count(n_blocks: int, least: int = 16) -> int:
    """Buckets hold about as many keys as a block: a power of two near the number of blocks."""
    return 1 << max(int(least - 1).bit_length(), int(n_blocks).bit_length())


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys."""
    if buckets == 1:
        return np.array([0, len(keys)])
    shift = 64 - (buckets.bit_length() - 1)
    firsts = np.arange(buckets, dtype=np.uint64) << np.uint64(shift)
    return np.append(np.searchsorted(keys, firsts), len(keys))


ASK = "bucket int, block long, keys binary, counts binary"
ANSWER = "block long, bucket int, counts binary"


def ask(keys: np.ndarray, counts: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """Rows that send a block's sorted distinct keys and its own counts of them to their buckets."""
    at = bounds(keys, buckets)
    used = np.flatnonzero(np.diff(at))
    parts = [(pack_keys(keys[at[b] : at[b + 1]]), squeeze(counts[at[b] : at[b + 1]].astype(np.uint32))) for b in used]
    columns = [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int64)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "counts"])


def _add_up(table: pa.Table) -> pa.Table:
    keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
    counts = [spread(x, np.uint32) for x in table["counts"].to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts))[place].astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [squeeze(part) for part in np.split(total, ends[:-1])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array(answers, pa.binary())})


def totals(asked: DataFrame) -> DataFrame:
    """Answers to rows of ask: for each block and bucket, the keys' counts over all blocks, in the block's order of keys."""
    return asked.groupBy("bucket").applyInArrow(_add_up, ANSWER)


def answer(table: pa.Table, n: int) -> np.ndarray:
    """A block's answers, in the order of its keys."""
    if not table.num_rows:
        return np.zeros(n, np.uint64)
    order = pc.sort_indices(table["bucket"])
    out = np.concatenate([spread(x, np.uint64) for x in table["counts"].take(order).to_pylist()])
    if len(out) != n:
        raise ValueError(f"a block of {n} keys got {len(out)} counts")
    return out


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(block's rows, its answers) for each block."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
