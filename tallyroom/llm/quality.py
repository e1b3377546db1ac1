"""Quality by a generalised additive model with pairwise interactions: cyclic boosting, scored by lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, crc_mod, release_memory, slices
from tallyroom.llm.labelled import bounded_sample, training_labels


SAMPLE = 16_384
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
FEATURES = (
    "log_chars log_words word_length upper digits signs rare_signs exclamations spaces non_ascii distinct_words repeated_words top_word line_length repeated_lines short_words long_words sign_words sentence_ends"
).split()
SLICE_BYTES = 2_000_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 300, 100, 0.08, 3

_KIND = np.zeros(256, np.uint8)  # of each byte: 1 lower, 2 upper, 3 digit, 4 space, 5 common sign, 6 other sign, 7 '!', 8 part of a non-ASCII character
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _KIND[_c] = 5 if chr(_c) in ".,;:?'\"()-" else 6
_KIND[ord("!")] = 7
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 8


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[offsets])


def _distinct(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and how often its most frequent one occurs."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    keys, counts = np.unique(rows * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of = keys // (int(codes.max(initial=0)) + 1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, counts)
    return np.bincount(of, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, over its whole bytes, words between white space, and lines. Null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    share = [_per_row(kind == k, offsets) for k in range(9)]
    size = np.diff(offsets)
    chars = np.maximum(1, size)
    letters = np.maximum(1, share[1] + share[2])

    words = pc.ascii_split_whitespace(texts)
    at = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    count = np.diff(at)
    some = np.maximum(1, count)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    signed = pc.match_substring_regex(coded.dictionary, r"[^\pL\pN.,;:?'()\-]").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(coded.dictionary, r"[.?!]$").to_numpy(zero_copy_only=False)
    distinct, most = _distinct(codes, at)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[at[:-1][count > 0]] = False

    lines = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lines.offsets).astype(np.int64)
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    line_count = np.maximum(1, np.diff(line_at))
    line_distinct, _ = _distinct(line_codes, line_at)
    lengths = length[codes]
    out = [
        np.log1p(size),
        np.log1p(count),
        _per_row(lengths, at) / some,
        share[2] / letters,
        share[3] / chars,
        share[5] / chars,
        share[6] / chars,
        share[7] / chars,
        share[4] / chars,
        share[8] / chars,
        distinct / some,
        _per_row(same, at) / some,
        most / some,
        np.log1p(size / line_count),
        1 - line_distinct / line_count,
        _per_row(lengths <= 3, at) / some,
        _per_row(lengths >= 12, at) / some,
        _per_row(signed[codes], at) / some,
        _per_row(ends[codes], at) / some,
    ]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Gam:
    """An intercept, a table per feature and a table per pair of features; a score is a sum of looked-up bins."""

    intercept: float
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """A shallow regression tree on ordered bins: the best splits, one at a time, and a Newton step per leaf."""
    spans = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(spans):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gain = (g[cuts] - g[a]) ** 2 / (h[cuts] - h[a] + ridge) + (g[b] - g[cuts]) ** 2 / (h[b] - h[cuts] + ridge) - gain_of(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), i, int(cuts[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best cross of one cut per axis on a grid of bins: four leaves, and what they gain."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    quads = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if min(gradient.shape) < 2:
        return np.zeros_like(gradient), 0.0
    gains = sum(a**2 / (b + ridge) for a, b in zip(quads(g), quads(h), strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(gradient)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + ridge)
    return out, float(gains[i, j] - gradient.sum() ** 2 / (weight.sum() + ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Gam:
    """Each round goes over all features in turn and adds a small tree on that feature alone to its table; then the pairs
    with the largest gain on what is left are boosted in the same way."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Gam(float(np.log(rate / (1 - rate))), [np.zeros(0)] * x.shape[1], [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    edges, pair_edges = [_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    pair_bins = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T, strict=True)]
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))), edges, pair_edges, [np.zeros(len(e) + 1) for e in edges])
    logit = np.full(len(y), model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            r, w = residual()
            step = RATE * _tree(np.bincount(b, r, len(edges[k]) + 1), np.bincount(b, w, len(edges[k]) + 1), LEAVES)
            model.tables[k] += step
            logit += step[b]
        if np.abs(residual()[0]).mean() < 0.004:
            break

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(pair_edges[a]) + 1, len(pair_edges[b]) + 1
        return np.bincount(pair_bins[a] * shape[1] + pair_bins[b], values, shape[0] * shape[1]).reshape(shape)

    r, w = residual()
    ranked = sorted(((_pair_tree(grid(a, b, r), grid(a, b, w))[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            r, w = residual()
            step = RATE * _pair_tree(grid(a, b, r), grid(a, b, w))[0]
            model.pair_tables[k] += step
            logit += step[pair_bins[a], pair_bins[b]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1), SLICE_BYTES):
            x = features(batch.column(1).slice(a, b - a))
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "x"])
    release_memory()


def _score(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    The model is fitted on at most sample labelled rows. Null texts count as empty; these have features too and score
    by them. Without labels of both classes, every row scores the base rate. Rows with equal texts score alike.
    Of labelled rows with one id, the one with the smallest features is learnt from. Extra columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = scratch.keep(rows.mapInArrow(_features, "doc_id long, x array<float>"), "features")
    train = bounded_sample(training_labels(labels, label, MODULUS, HELD_OUT), sample)
    picked = table.join(F.broadcast(train), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("v")).select("doc_id", "v.*").orderBy("doc_id").collect()
    x = np.array([r.x for r in picked], np.float32).reshape(-1, len(FEATURES))
    model = fit(x, np.array([r.label for r in picked], float))
    out = table.mapInArrow(_score(model), "doc_id long, score double")
    out = out.select("doc_id", (crc_mod(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    return scratch.finish(out, "scores")
