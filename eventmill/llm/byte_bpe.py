"""Byte-level BPE whose pre-tokenisation is array work: code point classes and a scan of transition functions.

A text is an array of code points. Its classes, which look up to two code points ahead, are
the letters of a small automaton that tells where a part of the split pattern begins. What
one class does to the automaton is a function on its states; composing functions is
associative and there are few of them, so all composed functions are numbered once and a
product is one look-up in a table. A long array is laid out in rows, the functions of all
rows are composed side by side, a logarithmic scan over the rows gives the state at the
start of each row, and a second sweep marks the boundaries. No regular expression runs over
a text. The slices between boundaries are merged by rank, remembered by slice. The byte
offsets of tokens are kept: decoding copies the vocabulary's bytes to those offsets.

The classes of code points are those of the installed tiktoken library, asked once for each
worker, since Unicode versions differ between libraries.

Defined results: a null or empty text has no ids; special tokens are ordinary text; texts of
any length are read whole, in stretches that hand on the automaton's state; repeated rows
and null ids are rows like others; an empty table gives no rows; further columns are ignored
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.llm.bpe import Remembered, Vocabulary

#: Code points that are looked at together; a longer text is read in stretches of so many.
STRETCH = 1 << 20
#: Rows that the scan handles side by side.
ROWS = 4096

LETTER, NUMBER, OTHER, SHORT, LONG, WHITE, SPACE, BLANK, END = range(9)
#: Letters that an apostrophe takes with it.
_AFTER_QUOTE = {"s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "re": LONG, "ve": LONG, "ll": LONG}
#: Stands behind each text.
_END_CODE = 0x110000

# States: what the next code point may continue.
_FREE, _LETTERS, _NUMBERS, _OTHERS, _SPACED, _WHITES, _ONE_LEFT, _TWO_LEFT = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """By state and class: the next state, and whether a part begins."""
    following = np.zeros((8, 9), np.uint8)
    begins = np.ones((8, 9), bool)
    runs = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS}
    for state in range(8):
        for kind, run in runs.items():
            following[state, kind] = run
            begins[state, kind] = state not in (run, _SPACED)
        # an apostrophe takes letters with it only where a part begins
        for kind, left in ((SHORT, _ONE_LEFT), (LONG, _TWO_LEFT)):
            inside = state in (_OTHERS, _SPACED)
            following[state, kind] = _OTHERS if inside else left
            begins[state, kind] = not inside
        following[state, WHITE], begins[state, WHITE] = _WHITES, state != _WHITES
        following[state, SPACE] = _SPACED  # the last of a run of white space, which the next part takes
        following[state, BLANK] = _FREE  # the last of a run, no space: a part of its own
        following[state, END], begins[state, END] = _FREE, False
    for state, after in ((_TWO_LEFT, _ONE_LEFT), (_ONE_LEFT, _FREE)):
        following[state, LETTER], begins[state, LETTER] = after, False
    return following, begins


def _monoid(following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that the classes compose to: their numbers by class, their products, and their values by state.

    The identity has number 0. Product [f, g] is f first, then g.
    """
    values = [tuple(range(8))]
    number = {values[0]: 0}
    of_class = []
    for kind in range(9):
        f = tuple(following[:, kind].tolist())
        if f not in number:
            number[f] = len(values)
            values.append(f)
        of_class.append(number[f])
    at = 0
    while at < len(values):
        for g in (values[k] for k in of_class):
            f = tuple(g[s] for s in values[at])
            if f not in number:
                number[f] = len(values)
                values.append(f)
        at += 1
    product = np.array([[number[tuple(g[s] for s in f)] for g in values] for f in values], np.uint16)
    return np.array(of_class, np.uint16), product, np.array(values, np.uint8)


_FOLLOWING, _BEGINS = _automaton()
_OF_CLASS, _PRODUCT, _VALUES = _monoid(_FOLLOWING)
_FLAT_FOLLOWING, _FLAT_BEGINS, _FLAT_PRODUCT, _COUNT = _FOLLOWING.ravel(), _BEGINS.ravel(), _PRODUCT.ravel(), len(_VALUES)


def _library_classes() -> np.ndarray:
    """The class of every code point, with ``SPACE`` for the space and ``BLANK`` for other white space."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    of_bytes = {bytes([b]): b for b in range(256)}
    out = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=of_bytes, special_tokens={})
        found = bytes(library.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    out[ord(" ")] = SPACE
    out[_END_CODE] = END
    return out


_classes: list[np.ndarray] = []


def classes_of_code_points() -> np.ndarray:
    if not _classes:
        _classes.append(_library_classes())
    return _classes[0]


def position_classes(codes: np.ndarray, ahead: int) -> np.ndarray:
    """The automaton's letter at each place but the last ``ahead``, which are only looked at."""
    kind = classes_of_code_points()[codes]
    n = len(codes) - ahead
    white = (kind == SPACE) | (kind == BLANK)
    out = kind[:n].copy()
    # white space before white space or the end of the text
    goes_on = white | (kind == END)
    out[white[:n] & goes_on[1 : n + 1]] = WHITE
    quotes = np.flatnonzero(codes[:n] == ord("'"))
    if len(quotes):
        one, two = codes[quotes + 1], codes[np.minimum(quotes + 2, len(codes) - 1)]
        for letters, taken in _AFTER_QUOTE.items():
            fits = one == ord(letters[0])
            if len(letters) == 2:
                fits &= two == ord(letters[1])
            out[quotes[fits]] = taken
    return out


def scan(kinds: np.ndarray, state: int = _FREE, rows: int = ROWS) -> tuple[np.ndarray, int]:
    """Whether a part begins at each place, if the automaton starts in ``state``, and the state in which it ends."""
    n = len(kinds)
    rows = max(1, min(rows, n // 16))
    width = -(-n // rows)
    laid = np.full(rows * width, 255, np.uint8)
    laid[:n] = kinds
    laid = np.ascontiguousarray(laid.reshape(rows, width).T)
    own = np.concatenate([_OF_CLASS, np.zeros(256 - len(_OF_CLASS), np.uint16)])[laid]  # 255: the identity
    whole = own[0]
    for column in own[1:]:
        whole = _FLAT_PRODUCT[whole.astype(np.intp) * _COUNT + column]
    step = 1
    while step < rows:  # functions of all rows up to and with each
        whole = np.concatenate([whole[:step], _FLAT_PRODUCT[whole[:-step].astype(np.intp) * _COUNT + whole[step:]]])
        step *= 2
    last = int(_VALUES[whole[-1], state])
    states = np.concatenate([[state], _VALUES[whole[:-1], state]]).astype(np.intp)
    begins = np.empty(laid.shape, bool)
    laid = np.where(laid == 255, np.uint8(END), laid)
    for k, column in enumerate(laid):
        at = states * 9 + column
        begins[k] = _FLAT_BEGINS[at]
        states = _FLAT_FOLLOWING[at].astype(np.intp)
    return begins.T.ravel()[:n], last


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """For each text, where its parts begin, in code points, and at last its length."""
    end = np.array([_END_CODE], "<u4").tobytes()
    joined = np.frombuffer(b"".join(t.encode("utf-32-le") + end for t in texts) + end, "<u4")
    starts = np.flatnonzero(scan(position_classes(joined, 1))[0])
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    cuts = np.searchsorted(starts, base)
    return [np.append(starts[a:b] - first, size) for (a, b), first, size in zip(pairwise(cuts.tolist()), base.tolist(), sizes.tolist(), strict=False)]


def long_boundaries(text: str, stretch: int = STRETCH) -> np.ndarray:
    """``boundaries`` of one text in stretches; the arrays hold one stretch at a time."""
    state, found = _FREE, []
    for a in range(0, len(text), stretch):
        part = text[a : a + stretch + 2].encode("utf-32-le")
        ahead = max(0, min(len(text) - a - stretch, 2))
        codes = np.frombuffer(part + np.array([_END_CODE] * (2 - ahead), "<u4").tobytes(), "<u4")
        begins, state = scan(position_classes(codes, 2), state)
        found.append(np.flatnonzero(begins) + a)
    return np.concatenate([*found, [len(text)]]).astype(np.int64)


class Ranks(Vocabulary):
    """A vocabulary given as ranks of byte strings; any two neighbours whose bytes have a rank may merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        count = 1 + max(self.id_of.values())
        self.start = [self.id_of[bytes([b])] for b in range(256)]
        self.ranks = [{} for _ in range(count)]
        for word, rank in self.id_of.items():
            for cut in range(1, len(word)):
                a, b = self.id_of.get(word[:cut]), self.id_of.get(word[cut:])
                if a is not None and b is not None:
                    self.ranks[a][b] = rank
        self.made = range(count)  # a merge of rank r makes the token r
        words: list[bytes] = [b""] * count
        for word, rank in self.id_of.items():
            words[rank] = word
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(words), np.uint8)

    def encode_slice(self, part: str) -> bytes:
        """The ids of one slice as little-endian 32-bit numbers."""
        whole = self.id_of.get(part.encode())
        ids = self.encode_word(part) if whole is None else [whole]
        return np.array(ids, "<u4").tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offsets at which tokens begin, and at last the number of bytes."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    def decoded(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ``ids``: the vocabulary's bytes copied to the tokens' offsets."""
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else offsets
        source = np.repeat(self.at[ids] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
        return self.blob[source].tobytes()


class Coder:
    """Encodes lists of texts. It remembers the ids of slices; long slices are merged anew."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.coded = Remembered(self.ranks.encode_slice)

    def encode(self, texts: list[str], stretch: int = STRETCH) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for group in _groups(texts, stretch):
            cuts = [long_boundaries(group[0], stretch)] if len(group) == 1 else boundaries(group)
            for text, places in zip(group, cuts, strict=True):
                o = places.tolist()
                yield np.frombuffer(b"".join([self.coded[text[a:b]] for a, b in pairwise(o)]), "<u4")
                self.coded.trim()


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """Neighbouring texts of about ``most`` code points together; a longer one stands alone."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each worker and path."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def round_trip(text: Column, path: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for texts in batches:
            rows = []
            for ids in own.encode([t or "" for t in texts]):
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.ranks.decoded(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return told(text)


def encode(text: Column, path: str) -> Column:
    """Struct of ``ids`` and ``offsets``: the byte at which each token begins in the text's UTF-8, and at last its length."""

    @F.pandas_udf("ids array<int>, offsets array<long>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for texts in batches:
            coded = [(ids.astype(np.int32), own.ranks.offsets(ids)) for ids in own.encode([t or "" for t in texts])]
            yield pd.DataFrame(coded, columns=["ids", "offsets"])

    return told(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of each array of ids; NULL stays NULL."""

    @F.pandas_udf("binary")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = coder(path).ranks
        for rows in batches:
            yield pd.Series([None if r is None else ranks.decoded(np.asarray(r, np.int64)) for r in rows], dtype=object)

    return told(ids)


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), round_trip(F.col(f"`{text_col}`"), path).alias("c")).select("doc_id", "c.*")
