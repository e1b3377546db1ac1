"""Phrase collocations: mergeable Misra-Gries summaries per hash partition find what may be frequent, a second pass counts exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, chain, fan_out, hash_words, join_groups, release_memory, slices

SLICE_BYTES = 12_000_000
LONGEST = 4  # words of a phrase
ROW_KEYS = 1_024  # of a bucket that one row holds
FILTER_BITS = 28  # log2 of the largest filter: 32 MB
FILTER_BITS_PER_KEY = 16
#: A-Z lower, tabs are blanks, and all ends of pieces are full stops.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_STOP = np.uint64(xxhash.xxh64_intdigest(b"."))
_U = np.uint64


def word_stream(texts: list[bytes], chunk: int = 1_000_000) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """64-bit hashes of the words of texts, in chunks; ends of pieces and texts are the hash of a full stop, which is in no word."""
    buffer = b".".join(texts).translate(TABLE)
    start = 0
    while start < len(buffer):
        end = start + chunk
        if end < len(buffer):  # words are whole: cut before a blank or an end
            found = [i for i in (buffer.find(b" ", end), buffer.find(b".", end)) if i >= 0]
            end = min(found, default=len(buffer))
        words = buffer[start:end].replace(b".", b" . ").split()
        yield hash_words(words), words
        start = end


class Filter:
    """A set of 64-bit keys as a bitmap of bounded size: what it denies is not in the set."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, _U(64 - int(len(bits)).bit_length() + 1 - 3)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def lang_key(lang: str | None) -> np.uint64:
    return _U(xxhash.xxh64_intdigest((lang if lang is not None else "und").encode(), 1))


def _runs(ok: np.ndarray, n: int) -> np.ndarray:
    """Places at which n true values begin."""
    out = ok[: len(ok) - n + 1].copy() if len(ok) >= n else np.zeros(0, bool)
    for k in range(1, n):
        out &= ok[k : k + len(out)]
    return out


def grams(h: np.ndarray, lang: np.uint64, level: str, kept: tuple[Filter, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, keys) of a stream's n-grams of one language. A key chains the language and the words' hashes.

    level short: words and pairs; long: what is longer and has only pairs that kept[0] holds; exact: all that kept holds.
    """
    word = h != _STOP
    places = np.flatnonzero(word)
    out = [(1, places, chain(lang, h[places]))]
    pairs = np.flatnonzero(_runs(word, 2))
    out.append((2, pairs, chain(chain(lang, h[pairs]), h[pairs + 1])))
    if level == "short":
        return out
    good = [(n, at[k], keys[k]) for n, at, keys in out for k in (kept[0](keys),)]
    pair = np.zeros(len(h), bool)
    pair[good[1][1]] = True
    pair_key = np.zeros(len(h), np.uint64)
    pair_key[good[1][1]] = good[1][2]
    longer, before, key = [], pair, pair_key
    for n in range(3, LONGEST + 1):
        # Both parts of n - 1 words are there: the first part's key goes on with the last word.
        at = np.flatnonzero(_runs(before, 2)) if n == 3 or level == "exact" else np.flatnonzero(_runs(pair, n - 1))
        keys = chain(key[at], h[at + n - 1])
        if level == "exact":
            k = kept[1](keys)
            at, keys = at[k], keys[k]
        longer.append((n, at, keys))
        before, key = np.zeros(len(h), bool), np.zeros(len(h), np.uint64)
        before[at], key[at] = True, keys
    return good + longer if level == "exact" else longer


def _streams(batch: pa.RecordBatch, spell: bool = False) -> Iterator[list[tuple[str, np.ndarray, dict[int, bytes]]]]:
    """Per slice of a batch: each language's stream, and its words by hash if they are to be spelt."""
    texts = batch.column(0).cast(pa.large_binary())
    langs = batch.column(1).to_pylist()
    for start, end in slices(texts, SLICE_BYTES):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[start:end], texts.slice(start, end - start).to_pylist(), strict=True):
            by.setdefault("und" if lang is None else lang, []).append(text or b"")
        out = []
        for lang, some in by.items():
            parts, known = [], {}
            for h, words in word_stream(some):
                parts.append(h)
                if not spell:
                    continue
                first = np.unique(h, return_index=True)[1]
                known.update((int(h[i]), words[i]) for i in first)
            out.append((lang, np.concatenate(parts) if parts else np.zeros(0, np.uint64), known))
        yield out


def _packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of the sorted keys that lie in one bucket (their first bits), ROW_KEYS at most."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)) if bits else np.zeros(1, int)
    for bucket, (a, b) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True)):
        for at in range(a, b, ROW_KEYS):
            yield bucket, slice(at, min(at + ROW_KEYS, b))


PARTIAL = "bucket int, kind int, mass long, keys binary, counts binary"


def _partials(level: str, kept, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = tuple(Filter(np.frombuffer(b.value, np.uint8)) for b in kept)
        for batch in batches:
            for streams in _streams(batch):
                found = [keys for lang, h, _ in streams for _, _, keys in grams(h, lang_key(lang), level, filters)]
                keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
                rows = [(bucket, 1, 0, keys[s].tobytes(), counts[s].astype(np.uint32).tobytes()) for bucket, s in _packed(keys, counts, bits)]
                mass: dict[int, int] = {}
                for bucket, s in _packed(keys, counts, bits):
                    mass[bucket] = mass.get(bucket, 0) + int(counts[s].sum())
                rows += [(bucket, 0, m, None, None) for bucket, m in mass.items()]
                for at in range(0, len(rows), 1_000):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1_000], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], PARTIAL_NAMES)
        release_memory()

    return run


PARTIAL_NAMES = [f.split()[0] for f in PARTIAL.split(", ")]


class Summary:
    """A mergeable Misra-Gries summary: capacity counters; a count is at most error too low, and mass bounds error * (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._open: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """What is added waits until there is as much of it as the summary holds."""
        self._open.append((keys, counts))
        self._n += len(keys)
        if self._n > max(self.capacity, 100_000):
            self.settle()

    def settle(self) -> None:
        if not self._open:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self._open)])
        counts = np.concatenate([self.counts, *(c for _, c in self._open)])
        self._open, self._n = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            less = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            counts = counts - less
            self.error += less
            stay = counts > 0
            keys, counts = keys[stay], counts[stay]
        self.keys, self.counts = keys, counts

    def merge(self, other: Summary) -> None:
        other.settle()
        self.error += other.error
        self.add(other.keys, other.counts)
        self.settle()

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have been seen least times; no other key has."""
        self.settle()
        return self.keys[self.counts + self.error >= least]


def _summed(least: int):
    """Buckets come one after the other, their masses first: the capacity exceeds mass / least, so that the error stays below least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def row() -> pa.RecordBatch:
            keys = summary.survivors(least) if summary else np.zeros(0, np.uint64)
            cut = range(0, len(keys), ROW_KEYS)
            return pa.record_batch([pa.array([now] * len(cut), pa.int32()), pa.array([len(keys[a : a + ROW_KEYS]) for a in cut], pa.int64()), pa.array([keys[a : a + ROW_KEYS].tobytes() for a in cut], pa.binary())], ["bucket", "n", "keys"])

        for batch in batches:
            for bucket, kind, m, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if bucket != now:
                    if now is not None:
                        yield row()
                    now, mass, summary = bucket, 0, None
                if kind == 0:
                    mass += m
                    continue
                summary = summary or Summary(mass // least + 1)
                summary.add(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64))
        if now is not None:
            yield row()
        release_memory()

    return run


def _bits(total: int):
    """Each bucket's part of the bitmap."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, buckets = rows["bucket"][0].as_py(), rows["buckets"][0].as_py()
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64)
        own = total - (buckets.bit_length() - 1)
        at = (keys >> _U(64 - total)) & _U((1 << own) - 1)
        bits = np.zeros(1 << own, np.uint8)
        bits[at.astype(np.int64)] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def _filter(survivors: DataFrame, bucket_bits: int, filter_bits: int) -> np.ndarray:
    """A bitmap of the survivors: 2 ** filter_bits bits at most, however many there are."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min(max(filter_bits, bucket_bits + 3), max(bucket_bits + 3, (n * FILTER_BITS_PER_KEY).bit_length()))
    out = np.zeros(1 << (bits - 3), np.uint8)
    own = 1 << (bits - 3 - bucket_bits)
    for r in survivors.withColumn("buckets", F.lit(1 << bucket_bits)).groupBy("bucket").applyInArrow(_bits(bits), "bucket int, bits binary").toLocalIterator():
        out[r.bucket * own : (r.bucket + 1) * own] = np.frombuffer(r.bits, np.uint8)
    return out


EXACT = "bucket int, keys binary, counts binary, parts binary, spelt array<string>"
COUNTED = "key long, n int, f long, lang_key long, w1 long, w2 long, w3 long, w4 long, l1 long, r1 long, l2 long, r2 long, l3 long, r3 long, middle long, spelt string"


def _exact_partials(kept, bits: int):
    """Counts of what passes the filters, with n, language and word hashes of each key. Words are spelt; a language is the empty
    phrase (n = 0), which counts all its words and is spelt as its name."""
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = tuple(Filter(np.frombuffer(b.value, np.uint8)) for b in kept)
        for batch in batches:
            for streams in _streams(batch, True):
                for lang, h, known in streams:
                    at_lang = lang_key(lang)
                    words = int((h != _STOP).sum())
                    whole = (0, np.zeros(1, int), chain(np.array([at_lang]), np.zeros(1, np.uint64)))
                    for n, at, found in [whole, *grams(h, at_lang, "exact", filters)]:
                        keys, first, counts = np.unique(found, return_index=True, return_counts=True)
                        parts = np.zeros((len(keys), 2 + n), np.uint64)
                        parts[:, 0], parts[:, 1] = n, at_lang
                        for k in range(n):
                            parts[:, 2 + k] = h[at[first] + k]
                        if n == 0:
                            counts[:] = words
                        spelt = [lang] if n == 0 else [known[x].decode() for x in parts[:, 2].tolist()] if n == 1 else None
                        rows = [(bucket, keys[s].tobytes(), counts[s].astype(np.int64).tobytes(), parts[s].tobytes(), spelt and spelt[s]) for bucket, s in _packed(keys, counts, bits)]
                        for start in range(0, len(rows), 1_000):
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[start : start + 1_000], strict=True), types, strict=True)], [c.split()[0] for c in EXACT.split(", ")])
        release_memory()

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parts(lang: np.ndarray, n: np.ndarray, w: np.ndarray) -> list[pa.Array]:
    """l1, r1, l2, r2, l3, r3, middle: keys of the first k words and of the rest, and of the two inner words of four."""

    def key(a: int, b: int, here: np.ndarray) -> np.ndarray:
        k = np.zeros(len(n), np.uint64)
        k[here] = lang[here]
        for i in range(a, b):
            k[here] = chain(k[here], w[i][here])
        return k

    out = []
    for k in range(1, LONGEST):
        there = n > k
        rest = np.zeros(len(n), np.uint64)
        for m in range(k + 1, LONGEST + 1):
            rest += key(k, m, n == m)
        out += [pa.array(x.view(np.int64), pa.int64(), mask=~there) for x in (key(0, k, there), rest)]
    return [*out, pa.array(key(1, 3, n == 4).view(np.int64), pa.int64(), mask=n != 4)]


def _counted(least: int):
    """Exact counts of a bucket's keys; frequent ones come with the keys of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, names = None, None, [], {}

        def settle() -> None:
            nonlocal held, waiting
            keys, counts, parts = (np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held, waiting = (keys[first], np.add.reduceat(counts, first), parts[order[first]]), []

        def rows() -> Iterator[pa.RecordBatch]:
            settle()
            often = (held[1] >= least) | (held[2][:, 0] == 0)
            key, f, p = held[0][often], held[1][often], np.ascontiguousarray(held[2][often].T)
            n, lang, w = p[0].astype(np.int32), p[1], p[2:]
            spelt = pa.array([names.get(k) for k in key.tolist()], pa.string())
            t = pa.record_batch([*(pa.array(x) for x in (key.view(np.int64), n, f, *(x.view(np.int64) for x in (lang, *w)))), *_parts(lang, n, w), spelt], [c.split()[0] for c in COUNTED.split(", ")])
            for at in range(0, t.num_rows, 10_000):
                yield t.slice(at, 10_000)

        for batch in batches:
            for bucket, keys, counts, parts, spelt in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if bucket != now:
                    if now is not None:
                        yield from rows()
                    now, held, names = bucket, None, {}
                keys = np.frombuffer(keys, np.uint64)
                narrow = np.frombuffer(parts, np.uint64).reshape(len(keys), -1)
                wide = np.zeros((len(keys), 2 + LONGEST), np.uint64)
                wide[:, : narrow.shape[1]] = narrow
                waiting.append((keys, np.frombuffer(counts, np.int64), wide))
                names.update(zip(keys.tolist(), spelt or (), strict=False))
                if len(waiting) >= 500:
                    settle()
        if now is not None:
            yield from rows()
        release_memory()

    return run


def count_frequent(docs: DataFrame, least: int, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """All phrases of up to LONGEST words with at least that many occurrences in their language, counted exactly (COUNTED)."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    bits = (2 * fan_out(docs) - 1).bit_length()
    filters = []
    for level in ("short", "long"):
        partial = texts.mapInArrow(_partials(level, tuple(filters), bits), PARTIAL)
        kept = partial.repartition(1 << bits, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_summed(least), "bucket int, n long, keys binary")
        kept = scratch.keep(kept, level)
        filters.append(sc.broadcast(_filter(kept, bits, filter_bits).tobytes()))
        scratch.drop(kept)
    partial = texts.mapInArrow(_exact_partials(tuple(filters), bits), EXACT)
    counted = scratch.keep(partial.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted(least), COUNTED), "counted")
    for f in filters:
        f.unpersist()
    return counted


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, covered: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words.

    A-Z count as lower case; pieces end at [.,;:!?\\x0A-\\x0D], words at blanks and tabs. a: occurrences of the phrase, at least `least`, within
    pieces and with overlaps; l and r: those of its two parts at the cut with the lowest score floor(2000000 a / (l + r)), ties to
    the shorter first part; n: words of the language. Phrases that lie inside a longer one with at least `covered` per cent of their
    occurrences go. Order: score, a (both falling), phrase (bytes). Null texts are empty, a null language is `und`; no words, no
    rows. Repeated rows count each time; ids and other columns are not read.

    Counting takes three scans. Words and pairs, then longer phrases of which all pairs may be frequent, go through Misra-Gries summaries per
    hash partition of their 64-bit keys, with more counters than occurrences / least, so that every frequent one survives; the last scan
    counts survivors exactly. Scans know survivors by a bitmap of bounded size, whose false positives cost time and change no result.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counted = count_frequent(docs, least, scratch, text_col, lang_col)
    phrases = counted.where("n >= 2")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    side = lambda c: F.struct(F.col("cut.k").alias("k"), F.lit(c).alias("side"), F.col(f"cut.{c}").alias("part"))
    cuts = phrases.select("key", "f", F.explode(F.array(*(cut(k) for k in range(1, LONGEST)))).alias("cut")).where("cut.l is not null")
    asked = cuts.select("key", "f", F.explode(F.array(side("l"), side("r"))).alias("x")).select("key", "f", "x.*")
    uses = asked.groupBy("part").agg(F.count(F.lit(1)).alias("uses"))
    answers = counted.select(F.col("key").alias("part"), F.col("f").alias("of_part")).join(uses, "part")
    answered = join_groups(asked, answers, ["part"], "uses", uses.agg(F.sum("uses")).first()[0] or 0)
    one = lambda c: F.max(F.when(F.col("side") == c, F.col("of_part"))).alias(c)
    scored = answered.groupBy("key", "k").agg(F.max("f").alias("a"), one("l"), one("r")).withColumn("score", F.expr("(cast(2000000 as decimal(38, 0)) * a) div (cast(l as decimal(38, 0)) + r)"))
    lowest = scored.groupBy("key").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("key", "x.*").drop("k")
    inner = F.explode(F.filter(F.array("l2", "r1", "l3", F.when(F.col("n") == 4, F.col("r2")), "middle"), lambda x: x.isNotNull()))
    longer = phrases.where("n > 2").select(inner.alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    hundred = F.lit(100).cast("decimal(38,0)")
    free = lowest.join(longer, "key", "left").where(F.col("longer").isNull() | (hundred * F.col("longer") < F.lit(covered) * F.col("a").cast("decimal(38,0)")))
    rows = free.join(phrases.select("key", "lang_key", "w1", "w2", "w3", "w4", F.col("n").alias("words")), "key")
    # What can't be among the best goes before a language meets in one task; ties stay until phrases are spelt.
    order = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("place", F.rank().over(Window.partitionBy("lang_key", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("place", F.rank().over(Window.partitionBy("lang_key").orderBy(*order))).where(F.col("place") <= top)
    rows = scratch.keep(rows, "best")
    spelt = counted.where("n = 1").select("lang_key", F.col("w1").alias("w"), "spelt")
    letters = rows.select("key", "lang_key", F.posexplode(F.slice(F.array("w1", "w2", "w3", "w4"), 1, F.col("words"))).alias("i", "w")).join(spelt, ["lang_key", "w"])
    text = letters.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "spelt"))), lambda x: x["spelt"]), " ").alias("phrase"))
    langs = counted.where("n = 0").select("lang_key", F.col("spelt").alias("lang"), F.col("f").alias("n"))
    full = rows.join(text, "key").join(langs, "lang_key")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long").alias("rank")
    return full.select("lang", rank, "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top)
