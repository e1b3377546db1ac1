"""Order-preserving packing into windows, cut by dynamic programming at document or sentence ends."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, release_memory
from tallyroom.llm.token_file import NULL_ID, ordered, with_end
from tallyroom.llm.word_bpe import load

WINDOW = 2048
#: Cost of a cut, in tokens of padding: at a document's end none, at a sentence's end, and inside a sentence.
SENTENCE_CUT, INNER_CUT = 24, 96
#: Inside a sentence, a cut may lie at every so many ids.
INNER_STEP = 64
SEGMENT_TOKENS = 1 << 19
SENTENCE_END = r"^[^\w]*[.!?…。！？][^\w]*</w>$"


def cut_points(sizes: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end and what each costs, in ascending order, from 0 to the number of ids.

    sentence_ends: the places after an id that ends a sentence. Stretches without any get places of their own,
    INNER_STEP apart, so that no two places are further apart than that.
    """
    doc_ends = np.cumsum(sizes)
    n = int(doc_ends[-1]) if len(doc_ends) else 0
    good = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(good)
    extra = (gaps - 1) // INNER_STEP
    inner = np.repeat(good[:-1], extra) + (np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1) * INNER_STEP
    places = np.concatenate([good, inner])
    cost = np.concatenate([np.full(len(good), SENTENCE_CUT), np.full(len(inner), INNER_CUT)])
    order = np.argsort(places, kind="stable")
    places, cost = places[order], cost[order]
    cost[np.isin(places, doc_ends) | (places == 0) | (places == n)] = 0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows that minimise padding plus cut costs; the windows are in order and have no gaps.

    f(j) = cost(j) + min over i of f(i) + padding(j - i). With padding window - (j - i), the minimum of f(i) + i
    over the sliding range j - window <= i < j stands at the head of a monotone queue. A window whose size
    is a power of two needs no padding: those few predecessors are looked up as well.
    """
    at, price = places.tolist(), cost.tolist()
    where = {p: k for k, p in enumerate(at)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + i, index of i), ascending in both
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - window:
            queue.popleft()
        low, source = queue[0][0] + window - p, queue[0][1]
        for size in powers:
            i = where.get(p - size)
            if i is not None and best[i] < low:
                low, source = best[i], i
        best[j], back[j] = low + price[j], source
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, file_no int, sequence_in_file long, offset long"


def _pack(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        ends_sentence = np.append(encoder.ids_matching(SENTENCE_END), np.zeros(max(0, end_id + 1 - encoder.n_ids()), bool))
        file_no, sequence = TaskContext.get().partitionId(), 0
        # What isn't packed yet: documents, the ids of each that are left, and all their ids.
        docs, left, whole, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def emit(final: bool):
            nonlocal docs, left, whole, ids, sequence
            places, cost = cut_points(left, np.flatnonzero(ends_sentence[ids]) + 1)
            ends = best_cuts(places, cost, window)
            if not final:
                ends = ends[:-1]  # the last window goes on into the next documents
            if not ends:
                return None
            done = ends[-1]
            doc_end = np.cumsum(left)
            doc_start = doc_end - left
            cuts = np.unique(np.concatenate([ends, doc_end[doc_end < done]])).astype(np.int64)
            starts = np.concatenate([[0], cuts[:-1]])
            doc = np.searchsorted(doc_end, starts, "right")
            seq = np.searchsorted(ends, starts, "right")
            seq_start = np.concatenate([[0], ends]).astype(np.int64)[seq]
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)]
            out = [
                pa.array(docs[doc], mask=docs[doc] == NULL_ID),
                pa.array(starts - doc_start[doc] + whole[doc] - left[doc]),
                pa.array(cuts - starts),
                pa.array(crcs, pa.int64()),
                pa.array(whole[doc]),
                pa.array(np.full(len(doc), file_no, np.int32)),
                pa.array(seq + sequence),
                pa.array(starts - seq_start),
            ]
            sequence += len(ends)
            stay = doc_end > done
            docs, whole, left = docs[stay], whole[stay], np.minimum(left[stay], doc_end[stay] - done)
            ids = ids[done:]
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for part, new, sizes in encoder.encode_slices(batch):
                new, sizes = with_end(new, sizes, end_id)
                docs = np.concatenate([docs, part.column(0).fill_null(NULL_ID).to_numpy()])
                left, whole, ids = np.concatenate([left, sizes]), np.concatenate([whole, sizes]), np.concatenate([ids, new])
                if len(ids) >= SEGMENT_TOKENS and (out := emit(False)) is not None:
                    yield out
        if len(ids) and (out := emit(True)) is not None:
            yield out
        release_memory()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in ascending id order: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; a null text is end_id alone. Each partition of the ordered documents is
    packed as a stream: segments of bounded size are cut by dynamic programming and each hands its
    last, unfinished window on. Only the last window of a partition is left short. Sequence ids run on over the
    partitions by one total per partition. Rows with equal ids are packed one after the other. An empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(ordered(docs, id_col, text_col).mapInArrow(_pack(tokenizer_path, end_id, window), PIECES), "pieces")
    files = pieces.groupBy("file_no").agg((F.max("sequence_in_file") + 1).alias("n")).orderBy("file_no").collect()  # one row per partition
    before, rows = 0, []
    for r in files:
        rows.append((r.file_no, before))
        before += r.n
    first = spark.createDataFrame(rows, "file_no int, first_sequence long")
    return pieces.join(F.broadcast(first), "file_no").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence_in_file") + F.col("first_sequence")).alias("sequence_id"), "offset"
    )
