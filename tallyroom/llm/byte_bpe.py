"""Byte-level BPE by merge ranks: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the tokenizer's pattern: the Unicode property, which Python's \s is not.
SPACE = "\t-\r \x85\xa0  -     　"
SLICE_BYTES = 6_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by merge rank. Three levels of 64-bit words say which ranks have any; find-first-set gives the lowest.

    A rank's bucket is a list of position arrays. Entries are not removed when a merge makes them stale: the caller
    skips those.
    """

    def __init__(self, ranks: int):
        self.top, self.middle, self.low = 0, [0] * ((ranks >> 12) + 1), [0] * ((ranks >> 6) + 1)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position to its rank's bucket."""
        if len(ranks) > 1:
            order = ranks.argsort(kind="stable")
            ranks, positions = ranks[order], positions[order]
            ends = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            if len(ends):
                starts = [0, *ends.tolist()]
                for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                    self.push(rank, positions[a:b])
                return
        if len(ranks):
            self.push(int(ranks[0]), positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with positions, and these from left to right."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        bits = self.middle[a]
        word = a << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.middle[a] = bits = self.middle[a] & (self.middle[a] - 1)
            if not bits:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, np.sort(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))


class Remembered:
    """Values of strings in two generations: when the young one is full, it becomes the old one, whose entries go."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


#: ASCII signs: those at a chunk's end are one match of the default pattern.
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


class ByteBpe:
    """Ids of whole texts, each match of the pattern separately, as a rank-file tokenizer without special tokens gives them."""

    LIMIT = 400_000

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
        self.known = Remembered(self.LIMIT)
        self.n = max(self.ranks.values()) + 1
        tokens = [b""] * self.n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        # Id n stands between matches: it has no pair.
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * (self.n + 1) + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        # Chunks between spaces stand alone unless the pattern is another one: its matches start before a space, not across it.
        self.by_space = pattern == default_pattern()
        #: A space inside or at the end of a run of white space, where a match may go on over it.
        self.bad_space = f"[{SPACE}] (?:[{SPACE}]|\\z)"

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; -1 where they don't merge."""
        keys = left.astype(np.int64) * (self.n + 1) + right
        if len(keys) <= 16:
            get = self.pairs.get
            return np.array([get(k, -1) for k in keys.tolist()], np.int32)
        at = np.minimum(self.pair_keys.searchsorted(keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes], exact: bool = False) -> list[bytes]:
        """Ids (32-bit) of each piece: its adjacent pair of lowest rank merges, the leftmost first, until none has a rank.

        One queue serves all pieces, which lie end to end with a barrier between; a bucket's positions merge at once,
        from left to right where they overlap. If a merge brings forth a pair of lower rank than its own, which an
        inconsistent rank file may have, the order inside that piece would matter: it is done once more
        with one merge at a time (exact).
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(size.sum()) + len(pieces) + 1
        # Slot 0 and the slot after each piece are barriers.
        barrier = np.concatenate([[0], np.cumsum(size + 1)])
        tok = np.full(total, self.n, np.int32)
        inside = np.ones(total, bool)
        inside[barrier] = False
        tok[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        here = np.append(self.pair_rank(tok[:-1], tok[1:]), np.int32(-1))
        queue = RankQueue(self.n)
        start = np.flatnonzero(here >= 0).astype(np.int32)
        queue.push_all(here[start], start)
        again: set[int] = set()
        while (entry := queue.pop()) is not None:
            rank, p = entry
            p = p[here[p] == rank]  # the others are stale
            if not len(p):
                continue
            if exact and len(p) > 1:
                queue.push(rank, p[1:])
                p = p[:1]
            q = after[p]
            if len(p) > 1 and (overlap := q[:-1] == p[1:]).any():
                # In a run of overlapping pairs every other one merges.
                first = np.append(True, ~overlap)
                number = np.arange(len(p))
                p = p[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
                q = after[p]
            end = after[q]
            tok[p] = rank
            after[p] = end
            before[end] = p
            here[q] = -1
            inside[q] = False
            left = before[p]
            if len(p) > 1:
                left = left[np.append(True, left[1:] != p[:-1])]
            changed = np.concatenate([left, p])
            new = self.pair_rank(tok[changed], tok[after[changed]])
            here[changed] = new
            has = new >= 0
            new, changed = new[has], changed[has]
            if not exact and len(new) and new.min() < rank:
                again.update((barrier.searchsorted(changed[new < rank]) - 1).tolist())
            queue.push_all(new, changed)
        ids = tok[inside].astype("<u4").tobytes()
        ends = (4 * np.append(0, np.cumsum(inside))[barrier]).tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i in again:
            out[i] = self.merge([pieces[i]], exact=True)[0]
        return out

    def matches(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; without the pattern for letters, and for letters and signs behind them."""
        if self.by_space and chunk.isascii() and chunk:
            word = chunk.rstrip(SIGNS)
            if word and (word[1:] if word[0] == " " else word).isalpha():
                return [word, chunk[len(word) :]] if len(word) < len(chunk) else [chunk]
        return self.pattern.findall(chunk)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; new matches of all of them merge together."""
        out = [self.known.get(c) for c in chunks]
        new = {c: self.matches(c) for c, found in zip(chunks, out, strict=True) if found is None}
        if not new:
            return out
        wanted = dict.fromkeys(m for parts in new.values() for m in parts)
        ids = {m: self.known.get(m) for m in wanted}
        fresh = [m for m, found in ids.items() if found is None]
        for first in range(0, len(fresh), self.LIMIT):
            some = fresh[first : first + self.LIMIT]
            ids.update(zip(some, self.merge([m.encode() for m in some]), strict=True))
        for m in fresh:
            if len(m) < 64:
                self.known.put(m, ids[m])
        for c, parts in new.items():
            if c not in ids:
                ids[c] = b"".join([ids[m] for m in parts])
                if len(c) < 64:
                    self.known.put(c, ids[c])
        return [ids[c] if found is None else found for c, found in zip(chunks, out, strict=True)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array's texts, and how many each has. Null counts as empty.

        Distinct chunks between spaces are looked up or encoded once and dealt out by Arrow. The first chunk of
        a text has no space before it, and texts with a space inside longer white space are encoded whole: both are
        entries of their own.
        """
        texts = texts.fill_null("")
        if self.by_space:
            whole = np.flatnonzero(pc.match_substring_regex(texts, self.bad_space).to_numpy(zero_copy_only=False))
        else:
            whole = np.arange(len(texts))
        odd = dict(zip(whole.tolist(), self.encode([texts[int(i)].as_py() for i in whole]), strict=True))
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        items = lists.flatten()
        firsts = items.take(pa.array(offsets[:-1])).to_pylist()
        coded = items.dictionary_encode()
        found = self.encode([" " + x for x in coded.dictionary.to_pylist()])
        index = coded.indices.to_numpy().copy()
        index[offsets[:-1]] = len(found) + np.arange(len(firsts))
        found += [odd.get(i, ids) for i, ids in enumerate(self.encode(firsts))]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), "<u4")))
        total = np.concatenate([[0], np.cumsum(sizes[index])])
        return ids.take(pa.array(index)).flatten().to_numpy(), np.diff(total[offsets])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """The bytes of each text of sizes ids."""
        parts = self.tokens.take(pa.array(ids))
        offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1) if len(parts) else np.zeros(1, np.int64)
        data = memoryview(parts.buffers()[2]) if len(parts) else memoryview(b"")
        ends = offsets[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, file and pattern."""
    return ByteBpe(path, pattern)


def _slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield start, end
        start = end


def _run(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(batch, texts):
                ids, sizes = bpe.encode_batch(texts.slice(a, b - a))
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                own = [hashlib.sha256(data[4 * x : 4 * y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
                decoded = bpe.decode(ids, sizes)
                out = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(own), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded])}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(ids.astype(np.int32)))
                    out["decoded"] = pa.array([bytes(x) for x in decoded], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the bytes they decode to.

    Whole texts of any length; null counts as empty and has no ids. Rows are independent: repeated ids and texts
    give repeated rows, an empty table none. Extra columns are not read. There is no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(path or default_path(), pattern or default_pattern(), keep_ids), schema)
