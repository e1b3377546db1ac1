"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on block-max inverted indexes, calibrated votes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, chain, crc_mod, hash_words, mix, release_memory, slices, words_of
from tallyroom.llm.labelled import Calibration, bounded_sample, training_labels

#: Labelled rows of each class from which marking terms are chosen; of each class in the index; of both for calibration.
TERM_SAMPLE, EXAMPLES, CALIBRATION = 3_072, 1_024, 16_384
#: Words are hashed to so many bits: weights and document frequencies of all terms are arrays of one size at any input.
HASH_BITS = 18
#: A marking term is LIFT times as frequent with one label, and weighs so many times its TF-IDF; at most so many such terms.
LIFT, MARK_WEIGHT, VOCABULARY = 4.0, 6.0, 4_096
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 32
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
SLICE_BYTES = 6_000_000


def terms_of(chunk: str) -> list[str]:
    """Terms of a chunk between white space: its words of letters in lower case, and their beginnings, marked by *."""
    out = []
    for word in _LETTERS.findall(chunk.lower()):
        out.append(word)
        out += [word[:k] + "*" for k in PREFIXES if len(word) > k]
    return out


def term_id(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << HASH_BITS) - 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: term, and the documents of each class that have it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update({t for chunk in set((text or "").split()) for t in terms_of(chunk)})
    terms = list(counts[0].keys() | counts[1].keys())
    if terms:
        yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", "n0", "n1"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key that near copies share most times: the smallest hash of a text's pairs of neighbouring words."""
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            h = mix(hash_words(words_of((text or "").encode())))
            keys.append(int(chain(h[:-1], h[1:]).min() if len(h) > 1 else h.sum()) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "label", "family"])


def choose_terms(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, least_docs: int = 4) -> list[str]:
    """Terms whose presence goes with the label: LIFT times as frequent with one of its values as with the other, and a
    log-likelihood ratio of over 20; the largest first, vocabulary at most.

    Near copies count once, by the row with the smallest id, or every rare word of a much-copied labelled text would seem to go with its label.
    """
    rows = docs.join(F.broadcast(labels), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    families = rows.mapInArrow(_families, "doc_id long, text string, label int, family long").groupBy("family", "label")
    rows = families.agg(F.min(F.struct("doc_id", "text")).alias("first")).select("first.text", "label").persist()
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []
    counts = rows.mapInArrow(_term_counts, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(f"a + b >= {least_docs}")
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n0 + n1)
    has, lacks = a + b, F.lit(n) - a - b
    cells = [(a, has * n0 / n), (b, has * n1 / n), (n0 - a, lacks * n0 / n), (n1 - b, lacks * n1 / n)]
    ratio = 2 * sum((part(x, e) for x, e in cells), F.lit(0.0))
    rate0, rate1 = (a + 0.5) / (n0 + 1), (b + 0.5) / (n1 + 1)
    marks = (rate1 >= LIFT * rate0) | (rate0 >= LIFT * rate1)
    best = counts.where(marks).select("term", ratio.alias("g")).where("g > 20").orderBy(F.desc("g"), "term").limit(vocabulary).collect()
    rows.unpersist()
    return sorted(r.term for r in best)


class Vectoriser:
    """Term frequencies of all words in whole texts, chunk by distinct chunk; of beginnings of words only marking ones count."""

    LIMIT = 400_000

    def __init__(self, marks: Iterable[str]):
        self.marks = frozenset(t for t in marks if t.endswith("*"))
        self.known: dict[str, tuple[int, ...]] = {}

    def of_chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            found = tuple(term_id(t) for t in terms_of(chunk) if t[-1] != "*" or t in self.marks)
            if len(chunk) < 64:
                self.known[chunk] = found
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and frequency, in that order; a text without terms has no entry."""
        lists = pc.utf8_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        found = [self.of_chunk(c) for c in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found))
        index = coded.indices.to_numpy()
        hits = np.flatnonzero(size[index] > 0)
        rows = np.searchsorted(np.asarray(lists.offsets), hits, "right") - 1
        chunk = index[hits]
        flat = np.array([t for x in found for t in x], np.int64)
        start = np.cumsum(size) - size
        n = size[chunk]
        terms = flat[np.repeat(start[chunk], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        keys, tf = np.unique(np.repeat(rows, n) << HASH_BITS | terms, return_counts=True)
        return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1), tf


def _vectors(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectoriser = Vectoriser(terms)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                rows, term, tf = vectoriser.batch(batch.column(1).slice(a, b - a))
                offsets = pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["doc_id", "terms", "tf"])
        del vectoriser
        release_memory()

    return run


class BlockMaxIndex:
    """Examples' unit vectors by term. For each block of BLOCK examples, a term's largest weight bounds what it can add.

    A query sums its terms' bounds for all blocks, reads the blocks in falling order of the bound, and stops
    where the bound can't reach the k-th best similarity any more: exact, as if every example were compared.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.ids, self.labels, self.blocks = ids, labels, -(-len(ids) // BLOCK)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        keys, first = np.unique(term[order] * max(1, self.blocks) + self.example // BLOCK, return_index=True)
        self.block, self.bound = (keys % max(1, self.blocks)).astype(np.int32), np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.at = np.append(first, len(term)).astype(np.int32)
        self.block_start = np.searchsorted(keys // max(1, self.blocks), np.arange(n_terms + 1)).astype(np.int32)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k nearest examples with a similarity over 0; ties go to the smaller id."""
        first = self.block_start[terms]
        n = self.block_start[terms + 1] - first
        used = np.flatnonzero(n)
        first, n = first[used], n[used]
        entries = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()), dtype=np.int32)  # of (term, block)
        weight = np.repeat(weights[used], n)
        block = self.block[entries]
        bound = np.bincount(block, weight * self.bound[entries], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # Entries in the order in which their blocks are read.
        rank = np.full(self.blocks, len(order), np.uint16 if self.blocks < 65_535 else np.int32)
        rank[order] = np.arange(len(order))
        rank = rank[block]
        by_rank = np.argsort(rank, kind="stable")
        ends = np.searchsorted(rank[by_rank], np.arange(len(order) + 1))
        entries, weight = entries[by_rank], weight[by_rank]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order):
            if len(best) >= k and bound[order[at]] < best[-1] - 1e-12:
                break
            last = min(len(order), at + step)
            if len(best) >= k:  # no further than a block can matter
                last = at + int(np.searchsorted(-bound[order[at:last]], -(best[-1] - 1e-12), "right"))
            some = entries[ends[at] : ends[last]]
            start = self.at[some]
            size = self.at[some + 1] - start
            postings = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()), dtype=np.int32)
            score = np.bincount(self.example[postings], np.repeat(weight[ends[at] : ends[last]], size) * self.weight[postings], len(self.ids))
            at, step = last, step * 2
            where = np.flatnonzero(score > 0)
            score = score[where]
            if without is not None:
                other = self.ids[where] != without
                where, score = where[other], score[other]
            if len(best) >= k:
                near = score >= best[-1]
                where, score = where[near], score[near]
            best_at, best = np.concatenate([best_at, where]), np.concatenate([best, score])
            top = np.lexsort((self.ids[best_at], -best))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best


def unit_vector(terms, tf, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """weight: of each term, its inverse document frequency, and MARK_WEIGHT times that if it is a marking one."""
    terms = np.asarray(terms, np.int64)
    values = (1 + np.log(np.asarray(tf, float))) * weight[terms]
    norm = np.sqrt((values**2).sum())
    return terms, values / norm if norm else values


def vote(index: BlockMaxIndex, at: np.ndarray, similarity: np.ndarray) -> float:
    """Share of label 1 among the neighbours, each weighted by one over its distance; one more vote is the mean of all examples."""
    weight = 1 / (1.02 - np.minimum(similarity, 1))
    return float(((weight * index.labels[at]).sum() + index.labels.mean()) / (weight.sum() + 1))


@dataclass
class Model:
    """What a task needs to find a vector's neighbours and vote."""

    weight: np.ndarray
    index: BlockMaxIndex
    k: int

    def raw(self, doc_id: int | None, terms, tf) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The vote of the neighbours, itself excepted; None without any."""
        if not len(terms):
            return None, np.zeros(0, np.int64), np.zeros(0)
        at, similarity = self.index.search(*unit_vector(terms, tf, self.weight), self.k, doc_id)
        return (vote(self.index, at, similarity) if len(at) else None), at, similarity


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: term, and how many documents have it."""
    counts = np.zeros(1 << HASH_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["term", "n"])


def term_weights(vectors: DataFrame, marks: list[str]) -> np.ndarray:
    """Inverse document frequencies over all rows, one entry per hashed term; marking terms weigh more."""
    n = vectors.count()
    rows = vectors.select("terms").mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << HASH_BITS)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    weight = np.log((1 + n) / (1 + df)) + 0.01
    weight[[term_id(t) for t in marks]] *= MARK_WEIGHT
    return weight


def fit(vectors: DataFrame, sample: DataFrame, weight: np.ndarray, k: int = NEIGHBOURS) -> Model:
    """An index over the sample's vectors. Of rows with one id, that with the smallest vector is the example."""
    first = vectors.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("terms", "tf", "label")).alias("v"))
    used = [(r.doc_id, r.v.label, unit_vector(r.v.terms, r.v.tf, weight)) for r in first.where("size(v.terms) > 0").collect()]
    # Blocks hold examples of one label that share their most common term, so mostly of one language, which keeps the blocks' bounds low.
    used.sort(key=lambda r: (r[1], int(r[2][0][weight[r[2][0]].argmin()]), int(r[2][0][r[2][1].argmax()]), r[0]))
    return Model(weight, BlockMaxIndex(np.array([r[0] for r in used], np.int64), np.array([r[1] for r in used], float), [r[2] for r in used], len(weight)), k)


VOTES = "doc_id long, raw double, evidence_ids array<long>, evidence_similarity array<double>"


def _votes(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, near, similar = [], [], []
            ends = np.asarray(batch.column(1).offsets).tolist()
            every, counts = np.asarray(batch.column(1).values), np.asarray(batch.column(2).values)
            tf_ends = np.asarray(batch.column(2).offsets).tolist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                tf = counts[tf_ends[i] : tf_ends[i + 1]]
                raw, at, similarity = model.raw(doc_id, every[ends[i] : ends[i + 1]], tf)
                raws.append(raw)
                near.append(model.index.ids[at].tolist())
                similar.append(similarity.tolist())
            columns = [batch.column(0), pa.array(raws, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(similar, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "raw", "evidence_ids", "evidence_similarity"])

    return run


def _calibrated(calibrate: Calibration, empty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_numpy(zero_copy_only=False)
            scores = np.where(np.isnan(raw), empty, calibrate(np.nan_to_num(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *batch.columns[2:]], names=["doc_id", "score", "evidence_ids", "evidence_similarity"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, evidence_ids and evidence_similarity (the nearest examples, nearest first).

    Vectors are over all words of the whole text, TF-IDF with document frequencies from all rows. Words and beginnings of
    words that go with the label, chosen on a bounded sample of labelled rows, weigh MARK_WEIGHT times as much. Examples
    are a bounded sample too, as many of each class. A text without words, null and empty ones included, scores
    what such texts do in the calibration sample; one that shares no word with any example likewise. A document is no
    neighbour of itself. Without labels of both classes, every row scores
    the base rate. Rows with equal ids and texts score alike. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Examples, votes and their calibration are of the training labels alone.
    train = scratch.keep(training_labels(labels, label, MODULUS, HELD_OUT), "labels")
    of_each = lambda limit: bounded_sample(train.where("label = 0"), limit).union(bounded_sample(train.where("label = 1"), limit))
    marks = choose_terms(rows, of_each(TERM_SAMPLE))
    vectors = scratch.keep(rows.mapInArrow(_vectors(marks), "doc_id long, terms array<int>, tf array<int>"), "vectors")
    model = fit(vectors, of_each(EXAMPLES), term_weights(vectors, marks))
    votes = scratch.keep(vectors.mapInArrow(_votes(model), VOTES), "votes")
    # No example is its own neighbour, so the examples' votes are what each gets when left out.
    seen = votes.join(F.broadcast(bounded_sample(train, CALIBRATION)), "doc_id").select("raw", "label").collect()
    voted = [r for r in seen if r.raw is not None]
    calibrate = Calibration(np.array([r.raw for r in voted]), np.array([r.label for r in voted]))
    rest = [r.label for r in seen if r.raw is None] or [r.label for r in seen]
    out = votes.mapInArrow(_calibrated(calibrate, (sum(rest) + 0.5) / (len(rest) + 1)), "doc_id long, score double, evidence_ids array<long>, evidence_similarity array<double>")
    held = crc_mod(F.col("doc_id"), MODULUS) == HELD_OUT
    out = out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence_ids", "evidence_similarity")
    return scratch.finish(out, "scores")
