"""Language-model scores by a probabilistic suffix tree of words.

A context of up to DEPTH words is a state of the tree if, each of its training positions left out in turn, its smoothed
next-word distribution predicts these positions better than the state that it would fall back to: the divergence
test. The same sums choose how strongly each state is smoothed towards that one. The tree grows from states: a context that is none
is not lengthened, nor is one after which training texts always go on with one word, as its longer contexts go on with the
same. A text's score multiplies the next-word probabilities of the longest suffix states.

Each depth is one exchange of packed keys (blocks.py): blocks of documents send what follows their contexts, with
counts and fallback probabilities, to the bucket that a context's hash names; the bucket sees all of a context's next words,
adds up, tests, and answers each block. The tree itself is never gathered. Words have numbers from the first exchange on, which counts
them; blocks are written anew with these and the counts, and the hashes go.
"""

from __future__ import annotations

import contextlib
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import blocks
from tallyroom.llm.common import Scratch, chain, crc_mod, fan_out, mix, release_memory

DEPTH = 3
#: Each depth asks in so many parts, by bucket: what one part shuffles is gone before the next. More parts take less disk, and more time,
#: as each reads the shorter contexts' answers anew. Pairs of words ask most.
PARTS = (1, 2, 1)
MODULUS, HELD_OUT = 5, 1
#: A context must have been seen so often. That drops no state: one seen once, left out, has no counts and gains nothing.
LEAST = 2
#: Strengths of smoothing that a state may have, in words; and by how many nats it must be better than its fallback.
STRENGTHS = np.array([0.5, 3.0, 30.0, 400.0, 6000.0])
MARGIN = 1.0
#: A context with so many training positions, or with more than one in 2**HOT_BITS of all, is dealt over all buckets by its next
#: words. There are at most 2**HOT_BITS of the latter kind, and only their verdicts come to the driver.
HOT_LEAST, HOT_BITS = 1 << 18, 20
_END = np.uint64(0x51ED270B8D5C5A3D)

ASK = "hot int, bucket int, block long, contexts binary, seen binary, sizes binary, words binary, counts binary, fallback binary"
ANSWER = "depth int, hot int, bucket int, block long, totals binary, verdicts binary"


def held_out(doc_id: int) -> bool:
    text = b"" if doc_id == blocks.NULL_ID else str(doc_id).encode()
    return zlib.crc32(text) % MODULUS == HELD_OUT


class Stats:
    """Training tokens, distinct ones, training texts, what makes a context hot, and how contexts are called; numbers of words are less than names."""

    def __init__(self, tokens: int, distinct: int, docs: int, names: int = 2**32 - 1):
        self.tokens, self.distinct, self.docs = tokens, distinct, docs
        #: Whole bytes: the parts of a key are packed apart then. The start of a text has the number after the last.
        self.bits, self.start = -(-names.bit_length() // 8) * 8, np.uint64(names)
        self.hot = max(HOT_LEAST, tokens >> HOT_BITS)
        #: Per depth the sorted keys of hot contexts and their verdicts.
        self.verdicts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hot_verdicts(self, depth: int, contexts: np.ndarray) -> np.ndarray:
        known, verdict = self.verdicts[depth]
        at = np.minimum(np.searchsorted(known, contexts), max(0, len(known) - 1))
        return np.where(known[at] == contexts, verdict[at], 0) if len(known) else np.zeros(len(contexts), np.int64)

    def paired(self, depth: int) -> bool:
        """Whether keys of contexts of so many words are two numbers side by side. Those of one word are its number, all others hashes."""
        return depth == 2 and 2 * self.bits <= 64

    def longer(self, depth: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of contexts of so many words, from those of one less and the words' numbers."""
        return context << np.uint64(self.bits) | word if self.paired(depth) else chain(mix(context), word)

    def hashes(self, depth: int, keys: np.ndarray) -> np.ndarray:
        return mix(keys) if depth == 1 or self.paired(depth) else keys

    def pack(self, depth: int, keys: np.ndarray) -> bytes:
        if not self.paired(depth):
            return blocks.pack_keys(keys)
        bits = np.uint64(self.bits)
        return blocks.squeeze(np.diff(keys >> bits, prepend=np.uint64(0)) << bits | keys & ((np.uint64(1) << bits) - np.uint64(1)))

    def unpack(self, depth: int, data: bytes) -> np.ndarray:
        if not self.paired(depth):
            return blocks.unpack_keys(data)
        bits, packed = np.uint64(self.bits), blocks.spread(data, np.uint64)
        return np.cumsum(packed >> bits, dtype=np.uint64) << bits | packed & ((np.uint64(1) << bits) - np.uint64(1))

    def word_probability(self, counts: np.ndarray, left_out: int) -> np.ndarray:
        return (np.maximum(counts.astype(np.float64) - left_out, 0) + 0.5) / (self.tokens - left_out + 0.5 * (self.distinct + 1))


def dense(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pairs (a, b) from 0 on in the order of the pairs, and one position of each; a < n_a, b < n_b."""
    of_b, of_place = int(n_b).bit_length(), len(a).bit_length()
    if int(n_a).bit_length() + of_b + of_place > 64:  # a block of one very long document
        _, first, numbers = np.unique(a.astype(np.uint64) << np.uint64(of_b) | b.astype(np.uint64), return_index=True, return_inverse=True)
        return numbers, first
    packed = (a.astype(np.uint64) << np.uint64(of_b) | b.astype(np.uint64)) << np.uint64(of_place) | np.arange(len(a), dtype=np.uint64)
    packed.sort()
    place = (packed & np.uint64((1 << of_place) - 1)).astype(np.int64)
    packed >>= np.uint64(of_place)
    new = np.ones(len(a), bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    numbers = np.empty(len(a), np.int64)
    numbers[place] = np.cumsum(new) - 1
    return numbers, place[new]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


class Entries:
    """What a block asks about some positions: the distinct contexts, and the distinct (context, next word) whose count it can't tell.

    A word that the shorter context never has, the longer one never has; a word that it has once is single: at
    most once after the longer one. A training position whose single word follows that context in no held-out text is alone: its
    own count is all there is, and nobody else asks for it. If no two training positions of a context can have the same word, it gains nothing, is no
    state, and, if it is an ordinary one, isn't asked for. Ordinary contexts are sent by bucket and key, each with its words; hot ones only with words,
    by a bucket that the word takes part in. Contexts have numbers in the block, words their places in its vocabulary.
    """

    def __init__(self, number: np.ndarray, numbers: int, code: np.ndarray, names: np.ndarray, contexts: np.ndarray, seen: np.ndarray, train: np.ndarray, shorter: np.ndarray, alone: np.ndarray, depth: int, stats: Stats, buckets: int):
        known, single = ~train & (shorter == 0), train & (shorter == 1)
        self.found = train.astype(np.int64)  # where nothing is asked: at most once, and the context is no state
        at = np.full(numbers, -1)
        at[number] = np.arange(len(number))
        has = np.flatnonzero(at >= 0)
        first = at[has]
        at[has] = np.arange(len(has))
        of = at[number]
        every, seen = contexts[first], seen[first]
        is_hot = seen >= stats.hot
        ask = (seen - np.bincount(of, single, len(every)) >= 2) | is_hot
        # Ordinary contexts in the order of their buckets and keys; then hot ones.
        plain, other = np.flatnonzero(ask & ~is_hot), np.flatnonzero(is_hot)
        plain = plain[np.argsort(every[plain])]
        home = bucket_of(stats.hashes(depth, every[plain]), buckets)
        by_home = np.argsort(home.astype(np.min_scalar_type(buckets)), kind="stable")
        plain, home = plain[by_home], home[by_home]
        asked = np.concatenate([plain, other])
        rank = np.full(len(every), len(asked))
        rank[asked] = np.arange(len(asked))
        self.open = np.flatnonzero((rank[of] < len(asked)) & ~known & ~alone)
        self.place, one = dense(rank[of[self.open]], len(asked), code[self.open], len(names))
        self.first = self.open[one]
        context, word = rank[of[self.first]], code[self.first]
        n_usual = int(np.searchsorted(context, len(plain)))
        spread = bucket_of(chain(every[asked[context[n_usual:]]], names[word[n_usual:]]), buckets)
        order = n_usual + np.argsort(spread, kind="stable")
        if len(order):
            context[n_usual:], word[n_usual:], self.first[n_usual:] = context[order], word[order], self.first[order]
            back = np.arange(len(context))
            back[order] = np.arange(n_usual, len(context))
            self.place, spread = back[self.place], spread[order - n_usual]
        #: The words' numbers, and whether the shorter context has them once at most.
        self.words, self.single = names[word], shorter[self.first] <= 1
        start = np.append(True, (np.diff(context[n_usual:]) != 0) | (np.diff(spread) != 0)) if len(order) else np.zeros(0, bool)
        runs = asked[context[n_usual:][start]]
        self.contexts, self.seen = np.concatenate([every[plain], every[runs]]), np.concatenate([seen[plain], seen[runs]])
        self.sizes = np.concatenate([np.bincount(context[:n_usual], minlength=len(plain)), np.diff(np.append(np.flatnonzero(start), len(order)))]).astype(np.int64)
        self.hot = np.arange(len(self.contexts)) >= len(plain)
        self.bucket = np.concatenate([home, spread[start]])
        #: Of each position, where its context stands among the ordinary ones (-1: not there), and whether it is a hot one.
        self.context_at = np.where(rank < len(plain), rank, -1)[of]
        self.is_hot = is_hot[of]
        n = len(self.contexts)
        #: Rows, each of one bucket, in contexts; and where a context's words start.
        self.rows = np.append(np.flatnonzero(np.append(True, (np.diff(self.bucket) != 0) | (self.hot[1:] != self.hot[:-1]))), n) if n else np.zeros(1, np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))

    def send(self, block: int, depth: int, stats: Stats, counts: np.ndarray, held: np.ndarray, fallback: np.ndarray) -> pa.RecordBatch:
        """The rows. Counts, the last two bits of each marking what held-out texts have, and single words; the
        fallback's probabilities of the other words with a count."""
        columns: list[list] = [[] for _ in range(9)]
        words = self.words
        step = words - np.concatenate([np.zeros(1, np.uint64), words[:-1]])[: len(words)]
        heads = self.starts[:-1][self.sizes > 0]
        step[heads] = words[heads]
        told = (counts > 0) & ~self.single
        coded = (counts << np.uint32(2)) | (held.astype(np.uint32) << np.uint32(1)) | self.single
        for r, q in zip(self.rows[:-1].tolist(), self.rows[1:].tolist(), strict=True):
            a, b = int(self.starts[r]), int(self.starts[q])
            row = (int(self.hot[r]), int(self.bucket[r]), block, stats.pack(depth, self.contexts[r:q]), *(blocks.squeeze(x) for x in (self.seen[r:q], self.sizes[r:q], step[a:b], coded[a:b], fallback[a:b][told[a:b]])))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ASK.split(", ")])


NAMED = "block long, doc_ids binary, sizes binary, codes binary, numbers binary, counts binary"


class Positions:
    """Every position of a block's documents, the end included, with what the answers so far say about it. A row has hashes of words (BLOCK_SCHEMA), or
    numbers and counts (NAMED)."""

    def __init__(self, row: dict, answers: pa.Table | None, stats: Stats | None, buckets: int):
        self.block, self.answers, self.stats, self.buckets = row["block"], answers, stats, buckets
        self.p = self.word_count = self.numbers = None
        if "numbers" in row:
            self.doc_ids, size = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
            self.code, self.numbers, self.coded = blocks.spread(row["codes"], np.uint32).astype(np.int64), blocks.unpack_keys(row["numbers"]), blocks.spread(row["counts"], np.int64)
        else:
            self.doc_ids, starts, vocabulary, code = blocks.unpack_coded(row["doc_ids"], row["sizes"], row["words"])
            size = np.diff(starts)
            end = int(np.searchsorted(vocabulary, _END))
            self.vocabulary = np.insert(vocabulary, end, _END)
            self.code = np.full(len(code) + len(size), end, np.int64)
            self.code[np.arange(len(code)) + np.repeat(np.arange(len(size)), size)] = code + (code >= end)
        self.size = size
        self.starts = np.append(0, np.cumsum(size + 1))  # one end per document
        self.offset = np.arange(len(self.code)) - np.repeat(self.starts[:-1], size + 1)
        self.train = np.repeat(np.array([not held_out(i) for i in self.doc_ids.tolist()], bool), size + 1)

    def ask_words(self) -> pa.RecordBatch:
        """Counts of the words; the last bit of each marks what held-out texts have."""
        count, held = (np.bincount(self.code, x, len(self.vocabulary)).astype(np.uint32) for x in (self.train, ~self.train))
        return blocks.ask(self.vocabulary, (count << np.uint32(1)) | (held > 0), self.block, self.buckets)

    def _answer(self, depth: int) -> tuple[list[bytes], list[bytes]]:
        table = self.answers.filter(pc.equal(self.answers["depth"], depth))
        table = table.take(pc.sort_indices(table, sort_keys=[("hot", "ascending"), ("bucket", "ascending")]))
        return table["totals"].to_pylist(), table["verdicts"].to_pylist()

    def name_words(self) -> None:
        """Numbers and counts of words instead of their hashes."""
        totals, numbers = self._answer(0)
        coded = np.concatenate([blocks.spread(x, np.int64) for x in totals])
        if len(coded) != len(self.vocabulary):
            raise ValueError(f"block {self.block} asked for {len(self.vocabulary)} words and got {len(coded)}")
        number = np.concatenate([blocks.spread(x, np.uint64) for x in numbers])
        order = np.argsort(number)
        self.numbers, self.coded = number[order], coded[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.code = back[self.code]

    def named(self) -> pa.RecordBatch:
        row = [self.doc_ids.tobytes(), self.size.astype(np.uint32).tobytes(), blocks.squeeze(self.code.astype(np.uint32)), blocks.pack_keys(self.numbers), blocks.squeeze(self.coded)]
        return pa.RecordBatch.from_arrays([pa.array([self.block], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=[x.split()[0] for x in NAMED.split(", ")])

    def read(self, depth: int, left_out: int, part: int = 0, parts: int = 1) -> None:
        """Answers up to a depth: the probability of each position's word in the longest state of so many words before it, its
        own counts less left_out; and where the next depth's contexts, of one part of the buckets, can diverge."""
        if self.numbers is None:
            self.name_words()
        self.word_count = (self.coded >> 1)[self.code]
        alone = self.train & (self.coded == ONCE)[self.code]
        self.p = self.stats.word_probability(self.word_count, left_out)
        symbols = self.numbers[self.code]
        count, keys, number, numbers = self.word_count, symbols, self.code, len(self.numbers)
        going, sure = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
        start = self.starts[:-1]
        for d in range(1, depth + 2):
            # Contexts of d symbols, the start of the text being one, and how often training texts have them.
            context, seen, number = np.roll(keys, 1), np.roll(count, 1), np.roll(number, 1)
            context[start], seen[start], number[start] = self.stats.start, self.stats.docs if d == 1 else 0, numbers
            self.at = np.flatnonzero(going & (seen >= LEAST) & (self.offset >= d - 1))
            if d > depth and parts > 1:
                hashes, is_hot = self.stats.hashes(d, context[self.at]), seen[self.at] >= self.stats.hot
                hot = self.at[is_hot]
                hashes[is_hot] = chain(context[hot], symbols[hot])
                self.at = self.at[bucket_of(hashes, self.buckets) % parts == part]
            self.seen = seen[self.at]
            e = self.entries = Entries(number[self.at], numbers + 1, self.code[self.at], self.numbers, context[self.at], self.seen, self.train[self.at], count[self.at], alone[self.at], d, self.stats, self.buckets)
            if d > depth:
                return
            totals, verdicts = self._answer(d)
            total = np.concatenate([blocks.spread(x, np.int64) for x in totals]) if totals else np.zeros(0, np.int64)
            verdict = np.concatenate([blocks.spread(x, np.uint8) for x in verdicts]) if verdicts else np.zeros(0, np.uint8)
            if len(total) != len(e.words) or len(verdict) != len(e.contexts):
                raise ValueError(f"block {self.block} asked for {len(e.contexts)} contexts and {len(e.words)} words of depth {d} and got {len(verdict)} and {len(total)}")
            found = e.found.copy()
            found[e.open] = (total >> 1)[e.place]
            strength = np.append(0.0, STRENGTHS)[np.where(e.context_at >= 0, np.append(verdict, 0)[e.context_at], 0)]
            if e.is_hot.any():
                strength[e.is_hot] = np.append(0.0, STRENGTHS)[self.stats.hot_verdicts(d, context[self.at[e.is_hot]])]
            use = strength > 0
            at, s = self.at[use], strength[use]
            self.p[at] = (np.maximum(found[use] - left_out, 0) + s * self.p[at]) / (self.seen[use] - left_out + s)
            if d == DEPTH:
                return
            # Where a shorter context is always followed by this word, so is this one: as often as it is seen itself.
            count = np.where(sure & (self.offset >= d - 1), seen, 0)
            count[self.at] = found
            lone = alone[self.at]
            lone[e.open] = self.train[self.at[e.open]] & (total == ONCE)[e.place]
            alone[self.at] = lone
            going = np.zeros(len(symbols), bool)
            going[self.at] = use & (found < self.seen)
            sure[self.at] = found == self.seen
            # A context that is seen twice was asked for as a word after the shorter one, or is that one with its only next word.
            number += len(e.words)
            number[self.at[e.open]] = e.place
            numbers += 1 + len(e.words)
            keys = self.stats.longer(d + 1, context, symbols)

    def ask(self, depth: int) -> pa.RecordBatch:
        """What follows the contexts of the next depth: counts, and the fallback's probability of the word, without this position; for
        contexts of one word its count, which says the same."""
        e = self.entries
        train = self.train[self.at[e.open]]
        counts, held = (np.bincount(e.place, x, len(e.words)).astype(np.uint32) for x in (train, ~train))
        first = self.at[e.first]
        return e.send(self.block, depth, self.stats, counts, held > 0, self.word_count[first] if depth == 1 else self.p[first].astype(np.float32))


def divergence(count: np.ndarray, seen: np.ndarray, fallback: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """Per context and strength: the sum over its training positions of the log ratio to the fallback, each position left out."""
    sums = np.zeros((n, len(STRENGTHS)))
    for k, s in enumerate(STRENGTHS.tolist()):
        sums[:, k] = np.bincount(context, count * np.log((count - 1 + s * fallback) / (seen[context] - 1 + s) / fallback), n)
    return sums


def of_singles(singles: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The same sums over positions whose word the context has once: left out, it has none, and the fallback's probability cancels."""
    return singles[:, None] * np.log(STRENGTHS / (np.maximum(seen, 1)[:, None] - 1 + STRENGTHS))


def verdicts(sums: np.ndarray) -> np.ndarray:
    """1 and up: the best strength; 0: no state."""
    return np.where(sums.max(axis=1) > MARGIN, sums.argmax(axis=1) + 1, 0).astype(np.uint8) if len(sums) else np.zeros(0, np.uint8)


#: As blocks: a bucket's tokens and distinct words, and its sums of hot contexts.
WORD_SUMS, HOT_SUMS = -1, -2


#: An answer: a count, and a bit that marks a count of one which held-out texts ask for too. Without it:
ONCE = 1 << 1


def _marked(total: np.ndarray, held: np.ndarray) -> np.ndarray:
    return total << 1 | ((total == 1) & (held > 0))


def _add_up(depth: int, stats: Stats):
    """One bucket: the blocks' counts of each (context, word) added up, and a verdict for each context. Hot contexts, of
    which the bucket has a part, give a row of sums."""

    def run(table: pa.Table) -> pa.Table:
        hot, bucket = table["hot"][0].as_py(), table["bucket"][0].as_py()
        contexts, seens, lengths, words, counts, fallbacks = [], [], [], [], [], []
        for packed, seen, sizes, steps, count, fallback in zip(*(table[c].to_pylist() for c in ("contexts", "seen", "sizes", "words", "counts", "fallback")), strict=True):
            contexts.append(stats.unpack(depth, packed))
            seens.append(blocks.spread(seen, np.int64))
            size = blocks.spread(sizes, np.int64)
            lengths.append(size)
            step = blocks.spread(steps, np.uint64)
            total = np.cumsum(step, dtype=np.uint64)
            # Differences start anew at each context.
            starts = (np.cumsum(size) - size)[size > 0]
            words.append(total - np.repeat(total[starts] - step[starts], size[size > 0]))
            coded = blocks.spread(count, np.uint32)
            counts.append(coded)
            told = (coded > 3) & (coded & 1 == 0)
            fallbacks.append(np.zeros(len(coded)))
            fallbacks[-1][told] = stats.word_probability(blocks.spread(fallback, np.int64), 1) if depth == 1 else blocks.spread(fallback, np.float32)
        each, at, run_of = blocks.distinct(np.concatenate(contexts))
        seen = np.concatenate(seens)[at]
        context = np.repeat(run_of, np.concatenate(lengths))
        keys, first, place = blocks.distinct(chain(mix(each)[context], np.concatenate(words)))
        coded = np.concatenate(counts)
        total, held = (np.bincount(place, x, len(keys)).astype(np.int64) for x in (coded >> np.uint32(2), (coded >> np.uint32(1)) & np.uint32(1)))
        fallback, sent_by = np.zeros(len(keys)), np.concatenate(fallbacks)
        fallback[place[sent_by > 0]] = sent_by[sent_by > 0]
        used = np.flatnonzero(fallback)  # the others are single
        of = context[first][used]
        sums = divergence(total[used].astype(np.float64), seen, fallback[used], of, len(each))
        sent = np.bincount(of, total[used], len(each)).astype(np.int64)
        own = np.zeros(len(each), np.uint8) if hot else verdicts(sums + of_singles(seen - sent, seen))
        answers = [blocks.squeeze(x) for x in np.split(_marked(total, held)[place], np.cumsum([len(x) for x in words])[:-1])]
        said = [blocks.squeeze(x) for x in np.split(own[run_of], np.cumsum([len(x) for x in contexts])[:-1])]
        block = table["block"].to_pylist()
        if hot:
            block, answers, said = [*block, HOT_SUMS], [*answers, np.stack([each.view(np.int64), seen, sent]).tobytes()], [*said, sums.T.tobytes()]
        n = len(block)
        columns = [pa.array([depth] * n, pa.int32()), pa.array([hot] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(answers, pa.binary()), pa.array(said, pa.binary())]
        return pa.Table.from_arrays(columns, names=["depth", "hot", "bucket", "block", "totals", "verdicts"])

    return run


def _add_up_words(buckets: int):
    """One bucket of words: the blocks' counts added up, a number for each word, and a row of the bucket's tokens and distinct training
    words, and its number of words. No other word has the number; frequent words have small ones, which take less room than hashes where next words are sent."""

    def run(table: pa.Table) -> pa.Table:
        keys = [blocks.unpack_keys(x) for x in table["keys"].to_pylist()]
        distinct, _, place = blocks.distinct(np.concatenate(keys))
        coded = np.concatenate([blocks.spread(x, np.uint32) for x in table["counts"].to_pylist()])
        total, held = (np.bincount(place, x, len(distinct)).astype(np.int64) for x in (coded >> np.uint32(1), coded & np.uint32(1)))
        answers = [blocks.squeeze(x) for x in np.split(_marked(total, held)[place], np.cumsum([len(k) for k in keys])[:-1])]
        bucket = table["bucket"][0].as_py()
        number = np.empty(len(distinct), np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        named = [blocks.squeeze(x) for x in np.split(number[place], np.cumsum([len(k) for k in keys])[:-1])]
        block = [*table["block"].to_pylist(), WORD_SUMS]
        answers.append(np.array([total.sum(), (total > 0).sum(), len(distinct)], np.int64).tobytes())
        n = len(block)
        columns = [pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(block, pa.int64()), pa.array(answers, pa.binary()), pa.array([*named, None], pa.binary())]
        return pa.Table.from_arrays(columns, names=["depth", "hot", "bucket", "block", "totals", "verdicts"])

    return run


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield Positions(dict(zip(batch.schema.names, values, strict=True)), None, None, buckets).ask_words()

    return run


def _row(table: pa.Table) -> dict:
    return {name: table[name][0].as_py() for name in table.column_names}


def _name_words(buckets: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        at = Positions(_row(block), answers, None, buckets)
        at.name_words()
        out = pa.Table.from_batches([at.named()])
        release_memory()
        return out

    return run


def _ask_first(buckets: int, stats: Stats, part: int):
    """What blocks ask about contexts of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = Positions(dict(zip(batch.schema.names, values, strict=True)), None, stats, buckets)
                at.read(0, 1, part, PARTS[0])
                yield at.ask(1)
                del at
        release_memory()

    return run


def _ask(depth: int, buckets: int, stats: Stats, part: int):
    """What blocks ask once the shorter contexts are known."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        at = Positions(_row(block), answers, stats, buckets)
        at.read(depth - 1, 1, part, PARTS[depth - 1])
        out = pa.Table.from_batches([at.ask(depth)])
        release_memory()
        return out

    return run


HOT_ROWS = "context long, seen long, sent long, " + ", ".join(f"s{k} double" for k in range(len(STRENGTHS)))


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for heads, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            columns = [*np.frombuffer(heads, np.int64).reshape(3, -1), *np.frombuffer(sums, np.float64).reshape(len(STRENGTHS), -1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in HOT_ROWS.split(", ")])


def _hot_verdicts(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of hot contexts, at most 2**HOT_BITS or tokens / HOT_LEAST of them, and their verdicts over all buckets."""
    rows = answers.where(F.col("block") == HOT_SUMS).select("totals", "verdicts").mapInArrow(_hot_rows, HOT_ROWS)
    sums = (F.sum(f"s{k}").alias(f"s{k}") for k in range(len(STRENGTHS)))
    found = rows.groupBy("context").agg(F.max("seen").alias("seen"), F.sum("sent").alias("sent"), *sums).collect()
    context, seen, sent = (np.array([r[k] for r in found], np.int64) for k in range(3))
    order = np.argsort(context.view(np.uint64))
    every = np.array([tuple(r)[3:] for r in found]).reshape(-1, len(STRENGTHS)) + of_singles(seen - sent, seen)
    return context.view(np.uint64)[order], verdicts(every)[order]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(stats: Stats, buckets: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        at = Positions(_row(block), answers, stats, buckets)
        at.read(DEPTH, 0)
        per_doc = lambda x: np.add.reduceat(x, at.starts[:-1])  # noqa: E731  each document has its end
        out = pa.table(
            {
                "doc_id": pa.array(at.doc_ids, mask=at.doc_ids == blocks.NULL_ID),
                "held_out": pa.array([held_out(i) for i in at.doc_ids.tolist()]),
                "n_tokens": pa.array(np.diff(at.starts)),
                "n_known": pa.array(per_doc((at.word_count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(at.doc_ids), stats.tokens, np.int64)),
                "base_score": pa.array(per_doc(np.log10(stats.word_probability(at.word_count, 0)))),
                "score": pa.array(per_doc(np.log10(at.p))),
            }
        )
        release_memory()
        return out

    return run


@contextlib.contextmanager
def _named(scratch: Scratch, docs: DataFrame, n_docs: int, places: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[DataFrame, Stats, int]]:
    """Blocks of numbered words, with the words' counts. The blocks of hashes and their answers are gone."""
    with contextlib.ExitStack() as kept:
        with blocks.in_place(docs, id_col, text_col, block_bytes, "suffix_tree") as hashed:
            buckets = blocks.bucket_count(hashed.count())
            answers = scratch.keep(hashed.mapInArrow(_ask_words(buckets), blocks.ASK).groupBy("bucket").applyInArrow(_add_up_words(buckets), ANSWER), "answers")
            sums = [np.frombuffer(r.totals, np.int64) for r in answers.where(F.col("block") == WORD_SUMS).select("totals").collect()]  # one per bucket
            stats = Stats(int(sum(s[0] for s in sums)), int(sum(s[1] for s in sums)), n_docs, buckets * max((int(s[2]) for s in sums), default=0))
            rows = hashed.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(_name_words(buckets), NAMED)
            table = kept.enter_context(blocks.bucketed(rows, places, "suffix_tree"))
        scratch.drop(answers)
        yield table, stats, buckets


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Words stand between white space after lower-casing A-Z; each text has an end token; null counts as empty. The tree
    learns from rows whose crc32(id as text) mod 5 is not 1; rows without an id learn as the empty id. Words
    that no training text has are one symbol, as in the base score. Repeated rows count and score repeatedly. An
    empty table gives none. Extra columns are not read. Texts are cut into blocks of about block_bytes, whole documents each.
    """
    scratch = Scratch(docs.sparkSession, "suffix-tree")
    n_docs = docs.where(crc_mod(F.col(id_col), MODULUS) != HELD_OUT).count()
    places = fan_out(docs)
    with blocks.appendable(docs.sparkSession, places, "suffix_tree_answers") as answers, _named(scratch, docs, n_docs, places, id_col, text_col, block_bytes) as (table, stats, buckets):
        with_answers = lambda: table.groupBy("block").cogroup(answers.table().groupBy("block"))
        for depth in range(1, DEPTH + 1):
            new = []
            for part in range(PARTS[depth - 1]):
                if depth == 1:
                    asked = table.mapInArrow(_ask_first(buckets, stats, part), ASK)
                else:
                    asked = with_answers().applyInArrow(_ask(depth, buckets, stats, part), ASK)
                new.append(scratch.keep(asked.groupBy("hot", "bucket").applyInArrow(_add_up(depth, stats), ANSWER), "answers"))
                # Shuffled once, to where the blocks are: all later depths read them there.
                answers.append(new[-1].where("block >= 0"))
            stats.verdicts[depth] = _hot_verdicts(functools.reduce(DataFrame.union, new))
            scratch.drop(*new)
        return scratch.finish(with_answers().applyInArrow(_scores(stats, buckets), SCORES), "scores")
