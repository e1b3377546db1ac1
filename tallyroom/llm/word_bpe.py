"""Token ids by the tokenizers library, with the ids of each distinct chunk remembered."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "word_bpe_49k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class WordBpe:
    """Encodes whole texts exactly as the library does with add_special_tokens=False; special strings in a text are their own ids.

    A tokenizer that drops white space before its merges never joins symbols across it, so a text's ids are the
    ids of its white-space-separated chunks in order. Each distinct chunk goes through the library once
    and is remembered, up to a bounded number. Other tokenizer files, and texts with the four control characters
    that Python and the library disagree about as white space, go through the library whole.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.by_chunk = _drops_white_space(json.load(f))
        self.chunks = _Chunks(self)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word: str) -> bytes:
        """Ids of lower-case letters, which are one symbol sequence to the library's BPE model."""
        symbols = word if word.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array's texts, and how many each text has. Null counts as empty."""
        texts = texts.fill_null("")
        if not self.by_chunk:
            parts = [self.library(x) for x in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        found = self.chunks.of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(found), "<u4")))
        total = np.concatenate([[0], np.cumsum(sizes[index])])
        ends = total[np.asarray(lists.offsets)]
        return ids.take(coded.indices).flatten().to_numpy(), np.diff(ends)

    def encode_slices(self, batch: pa.RecordBatch, name: str = "text", limit: int = 6_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch with about limit bytes of text each (one row at least), their ids and their counts."""
        texts = batch.column(batch.schema.get_field_index(name))
        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            part = batch.slice(start, end - start)
            yield part, *self.encode_batch(part.column(batch.schema.get_field_index(name)))
            start = end

    def n_ids(self, *more: int) -> int:
        """One more than the largest id, more included."""
        return max([*self.tokenizer.get_vocab().values(), *more]) + 1

    def ids_matching(self, pattern: str) -> np.ndarray:
        """For each id, whether its vocabulary string matches."""
        out = np.zeros(self.n_ids(), bool)
        test = re.compile(pattern)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bool(test.search(token))
        return out


#: ASCII signs but no apostrophe: the library splits a chunk's letters from those that follow them.
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, others follow U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def _drops_white_space(spec: dict) -> bool:
    """True for: NFC, white space to one space, lower case; then a split that keeps only matches without white space."""
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x["type"] for x in normalizer.get("normalizers", [])]
    first, *rest = pre.get("pretokenizers") or [{}]
    return (
        [x["type"] for x in rest] == ["ByteLevel"]
        and steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "|[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "")
        # Special strings are found before anything else: inside a chunk, and never in one of letters and signs behind them.
        and all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or [])
    )


def _is_latin1(text: str) -> bool:
    """Letters up to U+00FF have one normal form and one lower case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Chunks:
    """Ids of chunks in two generations: when the young one is full, it becomes the old one, whose entries go."""

    def __init__(self, owner: WordBpe):
        self.owner, self.young, self.old = owner, {}, {}

    def __getitem__(self, chunk: str) -> bytes:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = self._encode(chunk)
            if len(self.young) >= self.owner.LIMIT:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def of(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.young.get, chunks))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self[chunks[i]]
        return found

    def _encode(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        lower = chunk.lower()
        word = lower.rstrip(_SIGNS)
        if not word.isalpha() or not (word.isascii() or _is_latin1(word)) or not (chunk.isascii() or _is_latin1(chunk)):
            return self.owner.library(chunk)
        if word != chunk:
            return self[word] + (self[lower[len(word) :]] if len(word) < len(lower) else b"")
        return self.owner.letters(word)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One per Python worker and file."""
    return WordBpe(path)
