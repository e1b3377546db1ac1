"""Token-id files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A dataset is a folder with two Parquet tables. ``codebook`` has one row per id that occurs: id, count, code
length. ``blocks`` has one row per block: file_no, block_no, first_token (ids before it in its file) and one
binary value in the layout of ``pack_block``. Blocks hold whole documents in ascending id order and are decoded
alone; each notes the bit at which every STEP-th id starts, so that a decoder runs over all these lanes at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, fan_out, input_partitions
from tallyroom.llm.word_bpe import load

MAGIC = 0x31425254
MAX_BITS = 16
STEP = 128
BLOCK_TOKENS = 1 << 17


# --- codes -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for symbols that don't occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if not len(symbols):
        return lengths
    if len(symbols) == 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols need more than {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(object) if counts.sum() > 2**50 else counts[order].astype(np.int64)
    n = len(order)
    # Each level merges the leaves with the pairs of the level below; of each level only the leaves' places are kept.
    levels, packages = [], weights[:0]
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for leaf in reversed(levels):
        chosen = leaf[:take]
        leaves = int(chosen.sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, width = 0, 0
    for length in range(1, MAX_BITS + 1):
        code <<= length - width
        width = length
        of = order[lengths[order] == length]
        codes[of] = code + np.arange(len(of), dtype=np.uint32)
        code += len(of)
    return codes


class Codec:
    """Encodes and decodes ids with one code; the decoder's table has an entry for each MAX_BITS bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths).astype(np.uint64)
        self._symbol = self._length = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._symbol is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            spans = (1 << (MAX_BITS - self.lengths[order])).astype(np.int64)
            fill = (1 << MAX_BITS) - int(spans.sum())
            self._symbol = np.concatenate([np.repeat(order, spans), np.zeros(fill, np.int64)]).astype(np.uint32)
            self._length = np.concatenate([np.repeat(self.lengths[order], spans), np.full(fill, MAX_BITS)]).astype(np.int64)
        return self._symbol, self._length

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit at which each STEP-th starts."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        size = self.lengths[ids]
        if not size.all():
            raise ValueError("an id isn't in the codebook")
        ends = np.cumsum(size)
        at = ends - size
        # A code lies in at most two 32-bit words: codes of a word don't overlap, so their sum is their union.
        shifted = self.codes[ids] << (np.uint64(64) - size.astype(np.uint64) - (at & 31).astype(np.uint64))
        word = at >> 5
        first = np.concatenate([[True], word[1:] != word[:-1]])
        starts = np.flatnonzero(first)
        words = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint64)
        words[word[starts]] += np.add.reduceat(shifted >> np.uint64(32), starts)
        words[word[starts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], at[::STEP]

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint32)
        symbol, length = self.tables()
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 16 | raw[1:-2] << 8 | raw[2:-1]  # the 24 bits from each byte on
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), STEP), np.uint32)
        last = n - (len(at) - 1) * STEP
        for k in range(STEP):
            if k == last:
                at = at[:-1]
            if not len(at):
                break
            bits = window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)
            out[: len(at), k] = symbol[bits]
            at = at + length[bits]
        return out.reshape(-1)[:n]


# --- blocks ----------------------------------------------------------------------------------------------------


def pack_block(codec: Codec, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Header (magic, documents, ids, payload bytes, CRC-32 of the ids), document ids, their sizes, bit offsets, bits; all little-endian."""
    data, marks = codec.encode(ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(data), zlib.crc32(ids.astype("<u4").tobytes())], "<u8").tobytes()
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + marks.astype("<u4").tobytes() + data


def unpack_block(codec: Codec, value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, sizes and token ids of a block, checked against its CRC-32."""
    magic, docs, n, size, crc = np.frombuffer(value, "<u8", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = 40
    doc_ids = np.frombuffer(value, "<i8", docs, at)
    sizes = np.frombuffer(value, "<u4", docs, at := at + 8 * docs).astype(np.int64)
    marks = np.frombuffer(value, "<u4", -(-n // STEP), at := at + 4 * docs)
    at += 4 * len(marks)
    ids = codec.decode(value[at : at + size], marks, n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block is damaged")
    return doc_ids, sizes, ids


# --- jobs ------------------------------------------------------------------------------------------------------

RAW_SCHEMA = "file_no int, block_no int, first_token long, doc_ids binary, sizes binary, ids binary"
NULL_ID = -(2**63)


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) in ascending id order over all partitions; partitions follow the input's size."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = fan_out(docs) if input_partitions(docs) > 1 else 2
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """end_id after each document."""
    ends = np.cumsum(sizes)
    return np.insert(ids, ends, end_id).astype(np.uint32), sizes + 1


def _tokenize(path: str, end_id: int):
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = load(path), zstandard.ZstdCompressor(level=1)
        file_no, block_no, first = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(encoder.n_ids(end_id), np.int64)
        narrow = np.uint16 if len(counts) <= 1 << 16 else np.uint32
        for batch in batches:
            for part, ids, sizes in encoder.encode_slices(batch):
                ids, sizes = with_end(ids, sizes, end_id)
                counts += np.bincount(ids, minlength=len(counts))
                doc_ids, ends, start = part.column(0).fill_null(NULL_ID).to_numpy(), np.cumsum(sizes), 0
                while start < len(ends):  # whole documents until a block is full
                    at = int(ends[start] - sizes[start])
                    stop = min(len(ends), int(np.searchsorted(ends, at + BLOCK_TOKENS)) + 1)
                    some = ids[at : int(ends[stop - 1])]
                    yield _raw(file_no, block_no, first, doc_ids[start:stop].tobytes(), sizes[start:stop].astype("<u4").tobytes(), squeeze.compress(some.astype(narrow).tobytes()))
                    first, block_no, start = first + len(some), block_no + 1, stop
        if block_no:
            yield _raw(file_no, -1, first, None, None, squeeze.compress(counts.tobytes()))

    return run


def _raw(file_no, block_no, first, doc_ids, sizes, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file_no], pa.int32()), pa.array([block_no], pa.int32()), pa.array([first], pa.int64()), *(pa.array([x], pa.binary()) for x in (doc_ids, sizes, ids))],
        names=["file_no", "block_no", "first_token", "doc_ids", "sizes", "ids"],
    )


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            counts = np.frombuffer(zstandard.decompress(value), np.int64)
            total = counts.copy() if total is None else total + counts
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])


def _encode(lengths: np.ndarray):
    import zstandard

    narrow = np.uint16 if len(lengths) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                ids = np.frombuffer(zstandard.decompress(row["ids"]), narrow)
                block = pack_block(codec, np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], "<u4"), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file_no"]], pa.int32()), pa.array([row["block_no"]], pa.int32()), pa.array([row["first_token"]], pa.int64()), pa.array([block], pa.binary())],
                    names=["file_no", "block_no", "first_token", "block"],
                )

    return run


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for first, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, sizes, ids = unpack_block(codec, value)
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(starts + first), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the dataset at folder, files and blocks in ascending document id order.

    The ids are made once and kept, with each partition's counts, in the shared folder; the global counts then
    give one code for all blocks. To the driver come one count per vocabulary entry and one total per file.
    Null texts are documents of the end id alone. Documents with equal ids stand in one file; null ids come first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    raw = scratch.keep(ordered(docs, id_col, text_col).mapInArrow(_tokenize(tokenizer_path, end_id), RAW_SCHEMA), "raw")
    counts = raw.where("block_no = -1").select("ids").mapInArrow(_id_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # at most one row per vocabulary entry
    vector = np.zeros(max([load(tokenizer_path).n_ids(end_id), *(r.id + 1 for r in found)]), np.int64)
    for r in found:
        vector[r.id] = r.n
    lengths = code_lengths(vector)
    book = [(int(i), int(vector[i]), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, count long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    files = raw.where("block_no = -1").select("file_no", "first_token").toPandas().sort_values("file_no")  # one row per file
    before = dict(zip(files.file_no.tolist(), (files.first_token.cumsum() - files.first_token).tolist(), strict=True))
    blocks = raw.where("block_no >= 0").mapInArrow(_encode(lengths), "file_no int, block_no int, first_token long, block binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    start = spark.createDataFrame([(int(k), int(v)) for k, v in before.items()], "file_no int, start long")
    start.coalesce(1).write.parquet(f"{folder}/files")
    scratch.drop(raw)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a dataset, decoded from its blocks: doc_id, start (ids before it), n_tokens, ids_crc32."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.length
    files = spark.read.parquet(f"{folder}/files")  # one row per file
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(files), "file_no")
    rows = blocks.select((F.col("first_token") + F.col("start")).alias("first_token"), "block")
    return rows.mapInArrow(_decode(lengths), "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids array<int>) of a dataset."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.length

    def run(batches):
        codec = Codec(lengths)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                doc_ids, sizes, ids = unpack_block(codec, value)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), lists], names=["doc_id", "ids"])

    return spark.read.parquet(f"{folder}/blocks").select("block").mapInArrow(run, "doc_id long, ids array<int>")
