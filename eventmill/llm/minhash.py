"""MinHash near-dedup by Order MinHash, verified by banded alignment.

A document is a sequence of words. Its word 5-grams, each labelled with its occurrence
number so that all are distinct, are sketched: one sketch takes the ``LENGTH`` labelled
k-mers that are least under a hash and keeps them in the order of the text, so it collides
in proportion to shared and equally ordered content. Documents of all lengths are sketched alike.

Documents that share a sketch are candidates. A pair is verified by aligning its words: the
longest common subsequence inside the band of diagonals that similarity 0.8 allows.
Similarity is matched / (n + m - matched); 1 minus it is a metric.

Copies collapse before sketching counts. A bucket is not expanded into pairs. In each of
some rounds, as long as one leaves half of the rows or less, its members are compared with one centre, the member that shares most sketches
with others. The members that are linked to the centre, and the centre, need no further
comparison in that bucket, since a link to one of them means a distance of at most 0.4 from
the centre; where another member is so near without being linked, the linked ones that
could reach it stay aside with it (``near``). Links contract to classes. Buckets that still
hold several classes are settled by an exact prefix filter among the members that share their
last centre: at similarity 0.8 two documents share most of their occurrence-labelled words, and
so one of the first of any fixed order, in which those that the centre lacks come first. Classes
meet there before their members do, so a large class does not multiply. No bucket is cut off.
Classes are the connected components of verified links.

Defined results: words are compared in lower case; a text of fewer than five words is one
k-mer; texts without a word are equal to each other only if they are equal as text; a null
text counts as empty; repeated rows are members of one class, of which one row is kept;
of equal ids the first row stays; null ids are ids like others and come last; an empty table
gives no rows; further columns are ignored, and ``keep_first`` returns them unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.llm.texts import pieces
from eventmill.plans.components import connected_components
from eventmill.plans.scratch import discard, materialize
from eventmill.plans.skew import heavy_keys, join_by_cells, partitions, skew_join

K, LEAST = 5, 0.8
LENGTH, COUNT = 2, 72
ROUNDS, WORD_BUCKETS, COUNT_PARTS = 3, 1 << 14, (1024, 16)
#: A member of this similarity to a centre or more may be linked to one that the centre is linked to.
NEAR = 1 - 2 * (1 - LEAST)

_WORD = re.compile(r"\w")
_EDGE = re.compile(r"\W")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters from which a text is read in pieces.
PIECE = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _odd(count: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _M1 + np.uint64(seed)) | np.uint64(1)


_POWERS = _odd(K, 5)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """For each code point, whether ``\\w`` matches it."""
    told = np.zeros(0x110000, bool)
    told[[m.start() for m in _WORD.finditer("".join(map(chr, range(0x110000))))]] = True
    return told


@lru_cache(maxsize=1)
def _weights(doublings: int) -> np.ndarray:
    return _odd(64 << doublings, 17)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of the whole text, in order: sums of code points, weighted by their place in the word."""
    text = (text or "").lower()
    rows = []
    for a, b in pieces(text, _EDGE, PIECE):
        c = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.zeros(len(c) + 2, bool)
        inside[1:-1] = _in_words()[c]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, size = edges[::2], edges[1::2] - edges[::2]
        if not len(first):
            continue
        begins = np.cumsum(size) - size
        letters = c[inside[1:-1]]
        place = np.arange(len(letters)) - np.repeat(begins, size)
        weights = _weights(max(0, int(size.max() - 1).bit_length() - 6))
        rows.append(_mix(np.add.reduceat(weights[place] * (letters + np.uint64(1)), begins) + size.astype(np.uint64) * _M1))
    return np.concatenate(rows) if rows else np.zeros(0, np.uint64)


def labelled(h: np.ndarray) -> np.ndarray:
    """``h`` where repeated values also tell their occurrence number, so that all differ."""
    ascending = np.sort(h)
    if (ascending[1:] == ascending[:-1]).any():
        order = np.argsort(h, kind="stable")
        same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
        run = np.arange(len(h))
        nth = run - np.maximum.accumulate(np.where(same, 0, run))
        h = h.copy()
        h[order] = np.where(nth == 0, h[order], _mix(h[order] + nth.astype(np.uint64) * _M1))
    return h


def kmers(w: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled word k-mers, in order."""
    if len(w) == 0:
        return w
    if len(w) < K:
        return _mix((w * _POWERS[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - K + 1
    h = w[:n] * _POWERS[0]
    for j in range(1, K):
        h = h + w[j : j + n] * _POWERS[j]
    return labelled(_mix(h))


def _least(h: np.ndarray, factors: np.ndarray, length: int) -> np.ndarray:
    """Places of the ``length`` least of the products of ``h`` with each factor, in order; of equal products the first."""
    n, rows = len(h), len(factors)
    values = (h[None, :] * factors[:, None]).ravel()
    # first the products under a bound that about 4 * length of a row pass
    flat = np.flatnonzero(values < np.uint32(4 * length * (2**32 // n))) if n > 16 * length else np.arange(values.size)
    row = flat // n
    count = np.bincount(row, minlength=rows)
    if (short := np.flatnonzero(count < length)).size:
        flat = np.sort(np.concatenate([flat[count[row] >= length], (short[:, None] * n + np.arange(n)).ravel()]))
        row = flat // n
        count = np.bincount(row, minlength=rows)
    keyed = values[flat].astype(np.uint64) << np.uint64(32) | (flat - row * n).astype(np.uint64)
    starts = np.cumsum(count) - count
    out = np.empty((rows, length), np.int64)
    for k in range(length):
        least = np.minimum.reduceat(keyed, starts)
        out[:, k] = least & np.uint64(2**32 - 1)
        keyed[keyed == least[row]] = np.uint64(2**64 - 1)
    return np.sort(out, axis=1)


_factors = lru_cache(maxsize=4)(_odd)


def _ordered(h: np.ndarray, length: int, count: int, seed: int) -> np.ndarray:
    """One number for each sketch: the ``length`` least k-mers under its hash, in text order."""
    factors = _factors(count, seed)
    if len(h) > length:
        # the upper halves order the k-mers; products of 32 bits are much faster
        high, narrow = (h >> np.uint64(32)).astype(np.uint32), (factors >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        step = max(1, min(count, 1_000_000 // len(h)))
        chosen = h[np.concatenate([_least(high, narrow[a : a + step], length) for a in range(0, count, step)])]
    else:
        chosen = np.broadcast_to(h, (count, len(h)))
    out = factors.copy()
    for j in range(chosen.shape[1]):
        out = _mix(out * _M1 + chosen[:, j])
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    return _ordered(h, LENGTH, COUNT, 202).view(np.int64) if len(h) else np.zeros(0, np.int64)


def matched_words(x: np.ndarray, y: np.ndarray, band: float) -> int:
    """The longest common subsequence whose matches lie within ``band`` of the diagonal.

    The rows of the alignment are the bits of one integer, of which a zero is a step of the
    length, so that a column is a few operations on whole rows.
    """
    n, m = len(x), len(y)
    most = min(n, m)
    differ = np.flatnonzero(x[:most] != y[:most])
    head = int(differ[0]) if len(differ) else most
    differ = np.flatnonzero(x[n - most + head :][::-1] != y[m - most + head :][::-1])
    tail = int(differ[0]) if len(differ) else most - head
    x, y = x[head : n - tail], y[head : m - tail]
    if not len(x) or not len(y):
        return head + tail
    places: dict[int, int] = defaultdict(int)
    both = set(x.tolist()) & set(y.tolist())
    for i, w in enumerate(x.tolist()):
        if w in both:
            places[w] |= 1 << i
    reach = int(band)
    window = (1 << (2 * reach + 1)) - 1
    every = (1 << len(x)) - 1
    rows = every
    for j, w in enumerate(y.tolist()):
        if w in both:
            at = places[w] & (window << (j - reach) if j >= reach else window >> (reach - j))
            if at:
                step = rows & at
                rows = ((rows + step) | (rows - step)) & every
    return head + tail + len(x) - rows.bit_count()


def aligned(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> tuple[bool, float]:
    """Whether two sequences of words have the similarity ``least`` by banded alignment, and the similarity.

    Where they have not, the second value is only a bound: similarity is not above it.
    """
    n, m = len(x), len(y)
    if not n or not m:
        return False, 0.0
    if n == m and (x == y).all():
        return True, 1.0
    bound = min(n, m) / max(n, m)
    if bound >= least:
        shared = len(np.intersect1d(labelled(x), labelled(y), assume_unique=True))
        bound = shared / (n + m - shared)
    if bound < least:
        return False, bound
    matched = matched_words(x, y, (n + m) * (1 - least) / (1 + least) + 1)
    similar = matched / (n + m - matched)
    return (True, similar) if similar >= least else (False, bound)


def _numbers(rows: list[np.ndarray]) -> pa.Array:
    """Rows of 64-bit numbers as arrays of longs."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in rows)]))


def _hashes(rows: pa.Array) -> Iterator[np.ndarray]:
    """The sequences of word hashes in binary ``rows``, each where it lies."""
    _, ends, held = rows.buffers()
    width = np.dtype(np.int64 if pa.types.is_large_binary(rows.type) else np.int32)
    ends = np.frombuffer(ends, width, len(rows) + 1, width.itemsize * rows.offset) if len(rows) else ()
    for a, b in zip(ends[:-1], ends[1:]):
        yield np.frombuffer(held, "<u8", (b - a) // 8, a) if b > a else np.zeros(0, np.uint64)


def _sketches(text: Column) -> Column:
    @F.arrow_udf("n int, sketches array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, rows = [], []
            for t in texts:
                w = word_hashes(t.as_py())
                sizes.append(len(w))
                rows.append(sketch(kmers(w)))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _numbers(rows)], names=["n", "sketches"])

    return made(text)


def _sequence(text: Column) -> Column:
    """The hashes of the words, as binary."""

    @F.arrow_udf("binary")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([word_hashes(t.as_py()).astype("<u8").tobytes() for t in texts], pa.binary())

    return made(text)


def _aligned(a: Column, b: Column) -> Column:
    @F.arrow_udf("linked boolean, bound double")
    def told(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [aligned(x, y) for x, y in zip(_hashes(a), _hashes(b), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.float64())], names=["linked", "bound"])

    return told(a, b)


def _commonness(sequences: DataFrame) -> np.ndarray:
    """How often words of each of ``WORD_BUCKETS`` hash buckets occur; this many numbers reach the driver, whatever the texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(WORD_BUCKETS, np.int64)
        for b in batches:
            for x in b["seq"]:
                held += np.bincount((labelled(np.frombuffer(x, "<u8")) % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [held.tobytes()]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [sum(np.frombuffer(x, np.int64) for x in rows["n"]).tobytes()]})

    parts = sequences.select("seq").mapInPandas(counted, "part int, n binary")  # one row a task
    for few in COUNT_PARTS:  # summed as a tree
        parts = parts.groupBy((F.col("part") % few).alias("few")).applyInPandas(summed, "part int, n binary")
    out = np.zeros(WORD_BUCKETS, np.int64)
    for r in parts.select("n").collect():  # 16 rows
        out += np.frombuffer(r.n, np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def first_words(w: np.ndarray, hub: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The first of a document's labelled words: those that ``hub`` lacks before the others, then by commonness and hash.

    As many as can precede the first common one with a document of ``least`` words or more: floor(0.2 n) + 1 at most, half of it where all are as long.
    """
    own = labelled(w)
    order = np.lexsort((own, common[(own % np.uint64(len(common))).astype(np.int64)], np.isin(own, labelled(hub))))
    before = len(own) - LEAST / (1 + LEAST) * (len(own) + max(LEAST * len(own), least))
    return own[order[: int(before + 1e-9) + 1]]


def _first_words(seq: Column, hub: Column, least: Column, common: np.ndarray, spark) -> Column:
    shared = spark.sparkContext.broadcast(common)

    @F.arrow_udf("array<long>")
    def made(seq: pa.Array, hub: pa.Array, least: pa.Array) -> pa.Array:
        return _numbers([first_words(x, y, shared.value, k) for x, y, k in zip(_hashes(seq), _hashes(hub), least.to_pylist(), strict=True)])

    return made(seq, hub, least)


def _address(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(F.lit(1), whole), "k2": F.xxhash64(F.lit(2), whole)}


class _Links:
    """Verified pairs of documents, each verified once: ``a < b, linked, bound``."""

    def __init__(self, sequences: DataFrame):
        self.sequences = sequences
        self.known = materialize(sequences.select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(True).alias("linked"), F.lit(1.0).alias("bound")).limit(0), "verified")

    def add(self, pairs: DataFrame) -> DataFrame:
        """Verify ``pairs(a, b)`` that are not known; the new rows."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs.join(self.known, ["a", "b"], "left_anti"), "pairs")
        s = self.sequences
        both = skew_join(pairs, s.select(F.col("rid").alias("a"), F.col("seq").alias("sa")), ["a"], F.col("b"))
        both = skew_join(both, s.select(F.col("rid").alias("b"), F.col("seq").alias("sb")), ["b"], F.col("a"), counted=pairs)
        new = materialize(both.select("a", "b", _aligned(F.col("sa"), F.col("sb")).alias("r")).select("a", "b", "r.*"), "verified")
        discard(pairs)
        self.known = self.known.unionByName(new)
        return new


def _centre_round(members: DataFrame, links: _Links, number: int) -> tuple[DataFrame, DataFrame]:
    """One comparison of every bucket with its centre: the members left, and those set aside.

    Members have ``bucket, rid, n, score`` and the last ``centre``. What is set aside has
    ``cell, centre, rid, n`` and ``aside``, true for the linked; a cell holds what is still to be compared among itself.
    """
    best = F.min(F.struct(-F.col("score"), "rid", "n")).alias("c")
    centres = members.groupBy("bucket").agg(best, F.count("*").alias("size")).where("size > 1")
    centres = materialize(centres.select("bucket", "size", F.col("c.rid").alias("centre"), F.col("c.n").alias("cn")), "centres")
    heavy = heavy_keys(centres, ["bucket"], "size", members.count())
    put = join_by_cells(members.drop("centre"), centres.drop("size"), ["bucket"], F.col("rid"), heavy).where("rid <> centre")
    # the same two documents meet in many buckets, at most COUNT
    pairs = materialize(put.groupBy("centre", "cn", "rid", "n", "score").agg(F.collect_list("bucket").alias("buckets")), "met")
    links.add(pairs.where(_alike(F.col("n"), F.col("cn"))).select(F.col("centre").alias("a"), F.col("rid").alias("b")))
    met = pairs.withColumns({"a": F.least("rid", "centre"), "b": F.greatest("rid", "centre")}).join(links.known, ["a", "b"], "left")
    bound = F.coalesce("bound", F.least("n", "cn") / F.greatest("n", "cn"))
    compared = materialize(met.select("centre", "rid", "n", "score", "buckets", F.coalesce("linked", F.lit(False)).alias("linked"), bound.alias("bound")), "compared")
    left = materialize(compared.where("NOT linked").select(F.explode("buckets").alias("bucket"), "centre", "rid", "n", "score"), "left")
    met = compared.select("centre", "rid", "n", "linked", "bound")
    discard(pairs, centres, members)
    # distances to the centre of two linked documents differ by 1 - LEAST at most
    close = ~F.col("linked") & (F.col("bound") >= NEAR)
    most = met.groupBy("centre").agg(F.max(F.when(close, F.col("bound"))).alias("most"), F.count("*").alias("size")).where("most IS NOT NULL")
    most = materialize(most, "near")
    beside = join_by_cells(met, most.drop("size"), ["centre"], F.col("rid"), heavy_keys(most, ["centre"], "size", met.count()))
    kept = beside.where(close | (F.col("linked") & (F.col("bound") <= F.col("most") + (1 - LEAST))))
    aside = kept.select(F.xxhash64("centre", F.lit(number)).alias("cell"), "centre", "rid", "n", F.col("linked").alias("aside")).distinct()
    aside = materialize(aside, "aside")
    discard(compared, most)
    return left, aside


def _alike(n: Column, m: Column) -> Column:
    """Lengths that similarity ``LEAST`` allows."""
    return F.least(n, m) >= LEAST * F.greatest(n, m)


def _across(cells: DataFrame, roots: DataFrame, sequences: DataFrame, links: _Links) -> DataFrame:
    """The classes after comparing the members of each cell that are of different ones: exact, by the first words of each.

    Documents of n and m words match t = 0.8 (n + m) / 1.8 of them at least. So each has at
    most n - t and m - t labelled words before the first common one, in any order that is the
    same for both, and m is 0.8 n and the cell's least length at least. The words that the cell's centre lacks come
    first: what makes a cell large, a passage or a common original, is in its centre. Then
    rare words come before common ones.
    """
    placed = materialize(cells.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "placed")
    kinds = placed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("aside").alias("aside"), F.min("n").alias("least"), F.count("*").alias("size"))
    kinds = materialize(kinds.where("lo <> hi AND aside").select("cell", "least", "size"), "kinds")
    mixed = join_by_cells(placed, kinds.drop("size"), ["cell"], F.col("rid"), heavy_keys(kinds, ["cell"], "size", placed.count()))
    cells_of = F.array_sort(F.collect_list("cell").over(Window.partitionBy("rid")))  # COUNT a round at most
    mixed = materialize(mixed.withColumn("lesser", F.filter(cells_of, lambda c: c < F.col("cell"))), "mixed")
    discard(placed)
    common = _commonness(sequences.join(mixed.select("rid").distinct(), "rid"))
    hub = sequences.select(F.col("rid").alias("centre"), F.col("seq").alias("hub"))
    begun = skew_join(mixed, hub, ["centre"], F.col("rid")).join(sequences, "rid").select("cell", "rid", "n", "root", "lesser", _first_words(F.col("seq"), F.col("hub"), F.col("least"), common, mixed.sparkSession).alias("words"))
    # a large cell's documents are spread over tasks before their words are
    spread = begun.repartition(partitions(begun), "rid", "cell").select("cell", "rid", "n", "root", "lesser", F.posexplode("words").alias("p", "g"))
    prefix = materialize(spread, "prefixes")
    # lesser cells that hold all the members of a class that have the word: all such cells of one member, the first of several
    low = F.get("lesser", F.lit(0))
    held = F.when(F.min("rid") == F.max("rid"), F.first("lesser")).when((F.count(low) == F.count("*")) & (F.min(low) == F.max(low)), F.array(F.min(low))).otherwise(F.array().cast("array<long>"))
    classes = prefix.groupBy("cell", "g", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(F.col("p") - F.col("n")).alias("slack"), F.min(F.struct((F.col("p") - F.col("n")).alias("slack"), "rid")).alias("head"), held.alias("lesser"))

    def side(k: str) -> DataFrame:
        return classes.select("cell", "g", *[F.col(c).alias(c + k) for c in ("root", "lo", "hi", "slack", "head", "lesser")])

    def fits(least: Column, slack: Column) -> Column:
        """``slack``, the words before the common one less all words, leaves room for the matches of ``least`` words of both."""
        return slack <= -LEAST / (1 + LEAST) * least + 1e-9

    alike = (F.col("lo1") * LEAST <= F.col("hi2")) & (F.col("lo2") * LEAST <= F.col("hi1"))
    room = fits(F.col("lo1") + F.col("lo2"), F.greatest("slack1", "slack2"))
    met = side("1").join(side("2"), ["cell", "g"]).where((F.col("root1") < F.col("root2")) & alike & room & ~F.arrays_overlap("lesser1", "lesser2"))
    met = met.select("cell", "g", "root1", "root2", F.col("head1"), F.col("head2"), F.col("lo2").alias("other_lo"), F.col("hi2").alias("other_hi"), F.col("slack2").alias("other_slack"))
    met = materialize(met, "met")
    # one pair of each two classes settles most of them; members follow only where classes stay apart
    roots = _roots(links.add(met.groupBy("root1", "root2").agg(F.min(F.struct("head1", "head2")).alias("h")).select(F.col("h.head1.rid").alias("a"), F.col("h.head2.rid").alias("b"))), roots)
    now = roots.select(F.col("rid").alias("__rid"), F.col("root").alias("__now"))
    for side in ("root1", "root2"):
        met = met.join(now, F.col(side) == F.col("__rid"), "left").withColumn(f"{side}_now", F.coalesce("__now", side)).drop("__rid", "__now")
    met = materialize(met.where("root1_now <> root2_now").drop("root1_now", "root2_now", "head1", "head2"), "apart")

    def member(k: str, name: str) -> DataFrame:
        return prefix.select("cell", "g", F.col("root").alias("root" + k), F.col("rid").alias(name), F.col("n").alias("n" + k), (F.col("p") - F.col("n")).alias("slack" + k))

    # a member of the first class is kept only if it can match some member of the other
    first = met.join(member("1", "a"), ["cell", "g", "root1"])
    first = first.where((F.col("n1") * LEAST <= F.col("other_hi")) & (F.col("other_lo") * LEAST <= F.col("n1")) & fits(F.col("n1") + F.col("other_lo"), F.greatest("slack1", "other_slack")))
    pairs = first.join(member("2", "b"), ["cell", "g", "root2"])
    pairs = pairs.where(_alike(F.col("n1"), F.col("n2")) & fits(F.col("n1") + F.col("n2"), F.greatest("slack1", "slack2"))).select("a", "b")
    return _roots(links.add(pairs), roots)


def _roots(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``rid, root`` of the linked documents; with ``before``, ``links`` join its classes."""
    edges = links.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if before is None:
        return materialize(connected_components(edges).withColumnRenamed("node", "rid"), "roots")
    for side in ("u", "v"):
        edges = edges.join(before.select(F.col("rid").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    over = materialize(connected_components(edges), "roots")
    moved = before.join(over.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("rid", F.coalesce("new", "root").alias("root"))
    single = over.join(before.select(F.col("rid").alias("node")), "node", "left_anti").select(F.col("node").alias("rid"), "root")
    return materialize(moved.unionByName(single), "roots")


def _members(base: DataFrame) -> DataFrame:
    """The sketches that several documents have: ``bucket, rid, n, score``; score counts what a document shares."""
    spread = base.select("rid", "n", F.explode("sketches").alias("bucket"))
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    total = base.agg(F.sum(F.size("sketches"))).first()[0] or 0
    members = materialize(join_by_cells(spread, shared, ["bucket"], F.col("rid"), heavy_keys(shared, ["bucket"], "size", total)), "buckets")
    scores = members.groupBy("rid").agg(F.sum("size").alias("score"))
    scored = materialize(members.drop("size").join(scores, "rid").withColumn("centre", F.lit(None).cast("long")), "members")
    discard(shared, members)
    return scored


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` and the text's address ``k1, k2`` of every row.

    ``class_id`` is the least id of the class, whose first row is kept.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumns(_address(F.col("text")))
    rows = source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "k1", "k2", _sketches(F.col("text")).alias("s"))
    sketched = materialize(rows.select("rid", "doc_id", "k1", "k2", "s.*"), "sketches")
    rows = materialize(sketched.select("rid", "doc_id", "k1", "k2"), "rows")
    copies = materialize(rows.groupBy("k1", "k2").agg(F.min("rid").alias("copy_of"), F.count("*").alias("copies")), "copies")
    base = sketched.join(copies.select(F.col("copy_of").alias("rid")), "rid", "left_semi")

    members = _members(base)
    discard(sketched)
    wanted = members.select("rid").distinct().join(rows.select("rid", "doc_id", "k1", "k2"), "rid")
    texts = source.join(wanted, [source.doc_id.eqNullSafe(wanted.doc_id), source.k1 == wanted.k1, source.k2 == wanted.k2]).select(wanted.rid, "text").dropDuplicates(["rid"])
    sequences = materialize(texts.select("rid", _sequence(F.col("text")).alias("seq")), "sequences")

    links, cells = _Links(sequences), []
    held = members.count()
    for k in range(rounds):
        members, aside = _centre_round(members, links, k)
        cells.append(aside)
        before, held = held, members.count()
        if 2 * held > before:  # so the rows of all rounds are at most twice those of the first, and the last
            break
    cells.append(members.select(F.col("centre").alias("cell"), "centre", "rid", "n", F.lit(True).alias("aside")).distinct())
    together = cells[0]
    for more in cells[1:]:
        together = together.unionByName(more)
    roots = _roots(links.known)
    roots = _across(together, roots, sequences, links)

    rooted = copies.join(roots.withColumnRenamed("rid", "copy_of"), "copy_of", "left").select("k1", "k2", F.coalesce("root", "copy_of").alias("root"))
    placed = join_by_cells(rows.select("rid", "doc_id", "k1", "k2"), rooted, ["k1", "k2"], F.col("rid"), heavy_keys(copies, ["k1", "k2"], "copies", rows.count()))
    placed = materialize(placed, "placed")
    discard(sequences)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    heads = materialize(placed.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("class_size")), "heads")
    classed = join_by_cells(placed, heads, ["root"], F.col("rid"), heavy_keys(heads, ["root"], "class_size", placed.count()))
    return classed.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.rid") == F.col("rid")).alias("kept"), "k1", "k2")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns."""
    told = near_duplicates(docs, id_col, text_col)
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias("__em_id"), F.col("k1").alias("__em_1"), F.col("k2").alias("__em_2"))
    gone = gone.groupBy("__em_id", "__em_1", "__em_2").agg(F.count("*").alias("__em_gone"))
    address = _address(F.col(f"`{text_col}`"))
    keyed = docs.withColumns({"__em_id": F.col(f"`{id_col}`"), "__em_1": address["k1"], "__em_2": address["k2"]})
    same = [keyed[c].eqNullSafe(gone[c]) for c in ("__em_id", "__em_1", "__em_2")]
    clear = keyed.join(gone, same, "left_anti")
    # rows that repeat whole: all but one of them are gone, unless their class keeps another row
    stay = told.where("kept").select(F.col("doc_id").alias("__em_id"), F.col("k1").alias("__em_1"), F.col("k2").alias("__em_2"))
    twice = gone.select("__em_id", "__em_1", "__em_2").join(stay, [gone[c].eqNullSafe(stay[c]) for c in ("__em_id", "__em_1", "__em_2")], "left_semi")
    again = keyed.join(twice, [keyed[c].eqNullSafe(twice[c]) for c in ("__em_id", "__em_1", "__em_2")], "left_semi").dropDuplicates(["__em_id", "__em_1", "__em_2"])
    return clear.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])
