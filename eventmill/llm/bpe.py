"""Byte-level BPE: a heap of merge ranks over a doubly linked symbol list.

The heap holds (rank, position) of adjacent pairs. A popped entry is stale if the pair at
its position now has another rank; it is skipped. Decoding concatenates vocabulary strings
and maps their characters back to bytes. The vocabulary file is a parameter, never trained.

Defined results: a null text counts as empty and has no ids; special tokens in a text get
their own ids; decoding shows them; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed values: \p{L} and \p{N} below U+0250, where the standard library's ``re`` can stand for the pattern.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_WIDE_CHARS = re.compile("[\x1c-\x1fɐ-\U0010ffff]")

#: Words of one generation that a worker remembers.
REMEMBERED = 500_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Symbols, merges and special tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.char_of = _byte_chars()
        byte_of = {c: b for b, c in self.char_of.items()}
        self.start = [ids[self.char_of[b]] for b in range(256)]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.name_of = [str(i) for i in range(1 + max(self.bytes_of))]
        #: By left id: right id to rank; by rank: the id that the pair becomes.
        self.ranks: list[dict[int, int]] = [{} for _ in self.name_of]
        self.made = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[ids[a]].setdefault(ids[b], rank)
            self.made.append(ids[a + b])
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(special?, part) in order."""
        if self._special is None or not any(s in text for s in self.special):
            yield False, text
            return
        for k, part in enumerate(self._special.split(text)):
            if part:
                yield k % 2 == 1, part

    def encode_word(self, word: str) -> list[int]:
        start, ranks, made, pop, push = self.start, self.ranks, self.made, heapq.heappop, heapq.heappush
        ids = [start[b] for b in word.encode()]
        n = len(ids)
        bits = n.bit_length()
        heap = []
        row = ranks[ids[0]]
        for k, right in enumerate(ids):
            if k and right in row:
                heap.append(row[right] << bits | k - 1)
            row = ranks[right]
        if not heap:
            return ids
        heapq.heapify(heap)
        before, after, mask = list(range(-1, n)), list(range(1, n + 1)), (1 << bits) - 1
        while heap:
            entry = pop(heap)
            k = entry & mask
            left = ids[k]
            j = after[k]
            if left < 0 or j >= n or ranks[left].get(ids[j]) != entry >> bits:
                continue  # stale
            ids[k] = left = made[entry >> bits]
            ids[j] = -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (rank := ranks[left].get(ids[j])) is not None:
                    push(heap, rank << bits | k)
            i = before[k]
            if i >= 0 and (rank := ranks[ids[i]].get(left)) is not None:
                push(heap, rank << bits | i)
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, part in self.parts(text or ""):
            if special:
                out.append(self.special[part])
            else:
                for word in words(part):
                    out += self.encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def words(text: str) -> list[str]:
    """The parts of ``text`` that are merged each for itself."""
    if not _WIDE_CHARS.search(text):
        return _NARROW.findall(text)
    import regex

    return regex.findall(PATTERN, text)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker and path."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Remembered(dict):
    """What ``make`` gave for a word. It holds two generations of words at most: hot ones live on.

    Words of more than ``longest`` characters are made anew each time, so that memory is bounded.
    """

    def __init__(self, make: Callable[[str], str | bytes], most: int = REMEMBERED, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, word: str) -> str | bytes:
        if len(word) > self.longest:
            return self.make(word)
        got = self.old.get(word)
        self[word] = got = self.make(word) if got is None else got
        return got

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Pieces:
    """Codes texts piece by piece between spaces, remembering what each piece gave.

    No part of ``PATTERN`` holds a space but as its first character or inside a run of
    white space. Where no space touches other white space, a text is therefore its first
    piece and the further ones, each with its space, all split for themselves.
    """

    def __init__(self, make: Callable[[list[str]], str | bytes], most: int = REMEMBERED):
        self.make = make
        self.spaced = Remembered(self._piece, most)
        self.word = Remembered(lambda w: make([w]), most)

    def _piece(self, piece: str) -> str | bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return self.make(words(" " + piece))

    def __call__(self, text: str) -> list[str | bytes]:
        first, *more = text.split(" ")
        if not (more and first and first[-1].isspace()):
            coded = [*map(self.spaced.__getitem__, more)]
            self.spaced.trim()
            if None not in coded:
                return [self.make(words(first)), *coded] if first else coded
        self.word.trim()
        return [*map(self.word.__getitem__, words(text))]


class _Coder:
    """Ids of texts, comma-joined, and the bytes that they decode to."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        names, raw = self.vocab.name_of, {n: self.vocab.bytes_of.get(i, b"") for i, n in enumerate(self.vocab.name_of)}
        encode = self.vocab.encode_word
        self.ids = Remembered(lambda w: ",".join([names[i] for i in encode(w)]))
        self.text = Remembered(lambda ids: b"".join([raw[i] for i in ids.split(",")]), longest=400)

    def round_trip(self, text: str) -> tuple[int, str, str]:
        coded: list[str] = []
        for special, part in self.vocab.parts(text):
            coded += [str(self.vocab.special[part])] if special else map(self.ids.__getitem__, words(part))
        ids = ",".join(coded).encode()
        decoded = b"".join(map(self.text.__getitem__, coded))
        self.ids.trim()
        self.text.trim()
        if not _valid(decoded):
            decoded = decoded.decode("utf-8", "replace").encode()
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_coders: dict[str, _Coder] = {}


def round_trip(text: Column, path: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coders[path] = _coders.get(path) or _Coder(path)
        for texts in batches:
            yield pd.DataFrame([coder.round_trip(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return coded(text)


def encode(text: Column, path: str) -> Column:
    """The ids of each text, an array of int."""

    @F.pandas_udf("array<int>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for texts in batches:
            yield pd.Series([vocab.encode(t) for t in texts], dtype=object)

    return coded(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids."""

    @F.pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for rows in batches:
            yield pd.Series([None if r is None else vocab.decode(list(r)) for r in rows], dtype=object)

    return told(ids)


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), round_trip(F.col(text_col), path).alias("c")).select("doc_id", "c.*")
