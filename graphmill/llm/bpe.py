"""Byte-level BPE by a backtracking encoder, and its decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are compatible, that is, if no merge across their common border
would have come before the merges that built them.  The encoder therefore takes
the longest token at each place (found by Aho-Corasick), keeps it if it is
compatible with the token before, tries shorter ones otherwise and steps back
when none is left.  Places that failed once are never entered again, so the
time is linear in the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import re
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The public split pattern of this vocabulary, and what it comes to on ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

_SPLIT = regex.compile(PATTERN)
_SPLIT_ASCII = re.compile(ASCII_PATTERN, re.ASCII)
NEVER = 1 << 40


class Encoder(dict):
    """Ids of a word by lookup (``encoder[word]``); unknown words are encoded and kept."""

    #: Words kept before the cache is emptied; this bounds memory, not results.
    KEPT = 400_000

    def __init__(self, path: str = VOCABULARY) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.text = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for t, i in self.rank.items()}
        self._merged: dict[tuple[int, int], int] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for token, i in sorted(self.rank.items(), key=lambda x: x[1]):
            self._learn(token, i)
        self._fits.clear()
        self._words = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self._words.add_word(token.decode("latin-1"), i)
        self._words.make_automaton()

    def _learn(self, token: bytes, i: int) -> None:
        """Note which two tokens merge to this one, and the pieces along its two borders."""
        if len(token) > 1:
            rank = self.rank
            halves = [(a, b) for k in range(1, len(token)) if (a := rank.get(token[:k], i)) < i and (b := rank.get(token[k:], i)) < i]
            if len(halves) > 1:
                halves = [h for h in halves if self.compatible(*h)]
            if halves:
                a, b = halves[0]
                self._merged[a, b] = i
                # (piece, id of the token it is merged into); the token itself is never merged.
                self._left[i] = [*self._left[a][:-1], (a, i), (i, NEVER)]
                self._right[i] = [*self._right[b][:-1], (b, i), (i, NEVER)]
                return
        self._left[i] = self._right[i] = [(i, NEVER)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``a`` followed by token ``b`` stays as it is under all merges."""
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self._border_holds(self._right[a], self._left[b])
        return known

    def _border_holds(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        """Replay the merges on both sides of a border in order of rank."""
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self._merged.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self._shorter.get(token)
        if found is None:
            text = self.text[token]
            found = next((self.rank[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.rank), -1)
            self._shorter[token] = found
        return found

    def encode_bytes(self, word: bytes) -> list[int]:
        """Exact BPE of one piece of the split."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, size = len(word), self.size
        longest = [-1] * n
        for end, token in self._words.iter(word.decode("latin-1")):
            longest[end - size[token] + 1] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while True:
            before = out[-1] if out else -1
            while token >= 0 and (dead[pos + size[token]] or (before >= 0 and not self.compatible(before, token))):
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                pos += size[token]
                if pos == n:
                    return out
                token = longest[pos]
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                last = out.pop()
                pos -= size[last]
                token = self._next_shorter(last)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.KEPT:
            self.clear()
        ids = self[word] = tuple(self.encode_bytes(word.encode("utf-8", "replace")))
        return ids

    def encode(self, text: str) -> list[int]:
        words = (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)
        return list(chain.from_iterable(map(self.__getitem__, words)))

    def count(self, text: str) -> int:
        words = (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)
        return sum(map(len, map(self.__getitem__, words)))


class Decoder:
    """Bytes of id sequences by an offset table into one block of all token bytes."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(tokens) + 2, np.int64)
        for i, t in tokens.items():
            sizes[i + 1] = len(t)
        self.offset = np.cumsum(sizes)
        self.block = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.block[shift + np.arange(len(shift))].tobytes()


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One instance per Python worker and vocabulary."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(id, ids)`` of every row, in one pass without a shuffle.

    Null and empty texts give an empty list.  Strings that look like special
    tokens are ordinary text.  Repeated rows are encoded as often as they occur.
    Only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(Encoder, path)
        for batch in batches:
            # Small slices keep the Python lists of a batch of long texts small.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat: list[np.ndarray] = []
                ends = [0]
                for text in part.column(1).to_pylist():
                    ids = np.array(encoder.encode(text) if text else [], np.int32)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``(id, text)`` from ``(id, ids)``; null ids give null, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = loaded(Decoder, path)
        for batch in batches:
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All columns but the text, with ``n_tokens``; null and empty texts have 0."""
    kept = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(Encoder, path)
        for batch in batches:
            n = [encoder.count(t) if t else 0 for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64())], [*kept, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema) + ", n_tokens bigint"
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col)).mapInArrow(run, schema)
