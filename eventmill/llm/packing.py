"""Packing by shortest-pack-first over the length histogram.

Documents become ids and are cut into pieces of at most ``width``: full pieces from the
front and one rest. Only the histogram of piece lengths (at most ``width`` rows) reaches
the driver. Lengths are placed longest first, each into the emptiest kind of pack that
has room, updating the counts of packing patterns; there are at most about twice as many
patterns as lengths. Pieces then join the slots of the patterns by their rank among the
pieces of their length.

Where whole rests would leave more than ``slack`` of the space empty (as when one length
holds most documents), rests are cut at a smaller width: the largest of ``width / 2, / 4,
…, / 32`` that leaves little enough empty, or the one that leaves least. The histogram
tells it. Texts are encoded once: a rest is kept as the checksums of its finest parts, from
which those of larger pieces follow. Cutting keeps all ids, each in one piece.

Defined results: a null text counts as empty, and an empty document is one piece of its
end id alone; repeated rows and rows with null ids are packed each for itself; pieces of
one length take their slots in the order of a hash; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.llm.bpe import PATTERN, Pieces, vocabulary
from eventmill.plans.ranks import salted_rank
from eventmill.plans.scratch import materialize

WIDTH, END, SLACK = 2048, 1, 0.03
#: How often the width of a rest may be halved.
HALVINGS = 5


class _Encoder:
    """Ids of texts as little-endian bytes, as the tokenizers library gives them.

    The merges of single words run in tiktoken over the same vocabulary where ids follow
    the order of merges; a text with special tokens goes to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = vocabulary(path)
        self.special = [*vocab.special]
        if vocab.made == sorted(vocab.made):
            import tiktoken

            ranks = {vocab.bytes_of[i]: i for i in {*vocab.start, *vocab.made}}
            one = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            one = vocab.encode_word
        self.pieces = Pieces(lambda ws: np.array([i for w in ws for i in one(w)], dtype="<u4").tobytes())

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self.pieces(text))


_encoders: dict[str, _Encoder] = {}


def _finest(width: int) -> int:
    return max(1, width >> HALVINGS)


def _cuts(n: int, width: int, rest_width: int) -> list[int]:
    """Where ``n`` ids are cut: full pieces, then the rest."""
    return [*range(0, n - n % width, width), *range(n - n % width, n, rest_width), n]


def checksums(text: Column, path: str, width: int = WIDTH, end: int = END) -> Column:
    """Struct(tokens, crcs) of each text and its end id: checksums of its full pieces and of the finest parts of its rest."""

    @F.pandas_udf("tokens long, crcs array<long>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoders[path] = _encoders.get(path) or _Encoder(path)
        tail = np.array([end], dtype="<u4").tobytes()
        for texts in batches:
            out = []
            for t in texts:
                raw = encoder.encode(t or "") + tail
                cuts = _cuts(len(raw) // 4, width, _finest(width))
                out.append((len(raw) // 4, [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]))
            yield pd.DataFrame(out, columns=["tokens", "crcs"])

    return coded(text)


def _joined(crcs: list[int], sizes: list[int]) -> int:
    """The checksum of parts of ``sizes`` bytes laid end to end.

    What a part does to the checksum before it does not depend on its bytes, as CRC is linear: zeros do the same.
    """
    whole = crcs[0]
    for crc, size in zip(crcs[1:], sizes[1:]):
        zeros = bytes(size)
        whole = zlib.crc32(zeros, whole) ^ zlib.crc32(zeros) ^ crc
    return whole


def _pieces(tokens: int, crcs: list[int], width: int, rest_width: int) -> list[tuple[int, int, int]]:
    """start, length and crc32 of each piece."""
    fine = _cuts(tokens, width, _finest(width))
    at = {a: k for k, a in enumerate(fine)}
    cuts = _cuts(tokens, width, rest_width)
    parts = [(a, b, at[a], at[b]) for a, b in zip(cuts, cuts[1:])]
    return [(a, b - a, _joined(crcs[i:j], [4 * (y - x) for x, y in zip(fine[i:j], fine[i + 1 : j + 1])])) for a, b, i, j in parts]


def pieces(tokens: Column, crcs: Column, width: int, rest_width: int) -> Column:
    """Array of struct(start, length, crc) of the pieces of each text."""

    @F.pandas_udf("array<struct<start:long,length:long,crc:long>>")
    def cut(tokens: pd.Series, crcs: pd.Series) -> pd.Series:
        rows = [_pieces(int(n), [int(c) for c in cs], width, rest_width) for n, cs in zip(tokens, crcs)]
        return pd.Series([[dict(zip(("start", "length", "crc"), p)) for p in r] for r in rows], dtype=object)

    return cut(tokens, crcs)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as (list of (length, how many of it)), with the number of packs of each.

    Kinds of packs are held by the room they have left; the emptiest takes a length first.
    """
    room: list[tuple[int, int]] = []  # (room, pattern), ascending
    packs: list[list[list[int]]] = []
    counts: list[int] = []

    def put(pattern: list[list[int]], left: int, count: int) -> None:
        packs.append(pattern)
        counts.append(count)
        insort(room, (left, len(packs) - 1))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            if not room or room[-1][0] < length:
                # new packs, each filled before the next is opened
                each = width // length
                if n >= each:
                    put([[length, each]], width - each * length, n // each)
                if n % each:
                    put([[length, n % each]], width - n % each * length, 1)
                break
            left, at = room.pop()
            # every pack of this kind takes as many as make it no emptier than the next kind
            next_left = max([length, *(r for r, _ in room[-1:])])
            each = max(1, min((left - next_left) // length + 1 if left > next_left else 1, left // length))
            if counts[at] * each > n:
                each = max(1, n // counts[at])
            taken = min(counts[at], n // each)
            grown = [*map(list, packs[at])]
            if grown[-1][0] == length:
                grown[-1][1] += each
            else:
                grown.append([length, each])
            rest = counts[at] - taken
            if rest:
                counts[at] = rest
                insort(room, (left, at))
                put(grown, left - each * length, taken)
            else:
                packs[at] = grown
                insort(room, (left - each * length, at))
            n -= taken * each
    return [([tuple(x) for x in p], c) for p, c in zip(packs, counts)]


def empty_share(patterns: list[tuple[list[tuple[int, int]], int]], width: int) -> float:
    """Share of padding: packs are padded to ``width`` but where they end at a power of two."""
    pad = total = 0
    for pattern, count in patterns:
        used = sum(n * k for n, k in pattern)
        full = used if used & (used - 1) == 0 else width
        pad, total = pad + (full - used) * count, total + full * count
    return pad / total if total else 0.0


def _slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, pieces of this length in a pack, offset)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length, k in pattern:
            first = ranks.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, k, offset))
            ranks[length] = first + k * count
            offset += k * length
        sequence += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in slots.items()}


def _place(length: Column, rank: Column, slots: dict[int, np.ndarray]) -> Column:
    """Struct(sequence_id, offset); the slots grow with ``width``, not with the rows."""

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        size, rank_of = lengths.to_numpy(), ranks.to_numpy()
        for n in np.unique(size):
            mine = size == n
            rows = slots[int(n)]
            at = rows[np.searchsorted(rows[:, 0], rank_of[mine], side="right") - 1]
            pack, nth = np.divmod(rank_of[mine] - at[:, 0], at[:, 2])
            sequence[mine], offset[mine] = at[:, 1] + pack, at[:, 3] + nth * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return placed(length, rank)


def _cut_histogram(histogram: dict[int, int], width: int, rest_width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for n, c in histogram.items():
        parts = [n] if n == width else [rest_width] * (n // rest_width) + [n % rest_width] * (n % rest_width > 0)
        for p in parts:
            out[p] = out.get(p, 0) + c
    return out


def _rest_width(histogram: dict[int, int], width: int, slack: float) -> int:
    tried = []
    for rest in [width, *(_finest(width) << k for k in reversed(range(HALVINGS)))]:
        empty = empty_share(shortest_pack_first(_cut_histogram(histogram, width, rest), width), width)
        if empty <= slack:
            return rest
        tried.append((empty, -rest))
    return -min(tried)[1]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end: int = END, slack: float = SLACK) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    coded = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", checksums(F.col("text"), path, width, end).alias("c"))
    coded = materialize(coded.select("row", "doc_id", "c.*"), "coded")
    rests = coded.groupBy((F.col("tokens") % width).alias("rest")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / width)).alias("full")).collect()  # ``width`` rows at most
    whole = {r.rest: r.n for r in rests if r.rest}
    if full := sum(r.full for r in rests):
        whole[width] = full
    rest_width = _rest_width(whole, width, slack)
    made = F.explode(pieces(F.col("tokens"), F.col("crcs"), width, rest_width)).alias("p")
    table = materialize(coded.select("row", "doc_id", "tokens", made).select("row", "doc_id", "tokens", "p.*"), "pieces")
    patterns = shortest_pack_first(_cut_histogram(whole, width, rest_width), width)
    ranked = salted_rank(table, "length", ["row", "start"])
    return ranked.withColumn("at", _place(F.col("length"), F.col("rank"), _slots(patterns))).select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "at.sequence_id", "at.offset"
    )
