"""Ranked lexical search by the Best Position Algorithm, over shards of documents.

Each term has an impact list: the documents that hold it, highest impact first. An item reads
its terms' lists in step. A document that is met is scored at once by direct accesses to the
other lists, which also tell its position in each of them; so every list has a set of seen
positions, of which the best position ends the unbroken stretch from the top. No unseen
document scores more than the sum of the impacts at the best positions. The item stops when
this sum is strictly below its kth score, so that equal scores are all met and ties are right.

The corpus is read twice. The first pass turns each document into its length and the counts
of the terms that some item has; from them come the document frequencies. In the second pass
a task cuts its documents into shards of bounded size, whose lists lie in arrays, and takes
each item's kth score so far from shard to shard: later shards stop earlier. A task returns k
rows an item; nothing is shuffled but these. Items are taken in blocks, so what is broadcast
is bounded by a block.

Defined results: a null or empty text has no term, counts nowhere and is never returned; an
item without terms, or whose terms no document holds, has no rows; each row of ``items`` is
ranked for itself, repeated or null ``item_id`` included; documents of equal score come by
ascending ``doc_id``, nulls last; repeated documents are documents of their own; texts of any
length are read whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from eventmill.llm.texts import pieces
from eventmill.plans.scratch import materialize

K = 10
#: Fixed values of the score.
UNIT, SLOPE, BASE, SHARE = 1_000_000_000, 1000, 8, 75
#: Items of one block; what is broadcast is their terms.
ITEMS = 1000
#: Documents of a shard at most, and places of its arrays (terms x documents).
SHARD, CELLS = 4096, 1 << 24
#: Positions of each list that the first round reads; each further round reads twice as many.
FIRST = 16

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_EDGE = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(_LOWER)


def terms(text: str | None) -> Counter[str]:
    """How often each term occurs in the whole text."""
    text, raw = text or "", Counter()
    for a, b in pieces(text, _EDGE):
        raw.update(_TERM.findall(text, a, b))
    out: Counter[str] = Counter()
    for term, n in raw.items():
        out[_lower(term)] += n
    return out


def _vectors(text: Column, number: Any) -> Column:
    """Struct of ``n``, all terms, and of ``terms`` and ``counts``: the known terms of each text; ``number`` is broadcast."""

    @F.pandas_udf("n long, terms array<int>, counts array<long>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = number.value
        for texts in batches:
            rows = []
            for t in texts:
                found = terms(t)
                own = [(known[w], c) for w, c in found.items() if w in known]
                rows.append((found.total(), [x[0] for x in own], [x[1] for x in own]))
            yield pd.DataFrame(rows, columns=["n", "terms", "counts"])

    return told(text)


class Shard:
    """Impact lists of some documents: by list in flat arrays, and each list's positions and impacts by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        sizes = np.bincount(term, minlength=n_terms)
        self.size, self.start = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        position = np.arange(len(order)) - np.repeat(self.start, sizes)
        self.position = np.full((n_terms, n_docs), -1, np.int32)
        self.position[term[order], self.doc] = position
        self.impact_of = np.zeros((n_terms, n_docs), np.int32)
        self.impact_of[term[order], self.doc] = self.impact
        self.n_docs = n_docs

    def best(self, own: np.ndarray, weight: np.ndarray, place: np.ndarray, k: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the ``k`` highest, equal ones by ``place``, and the direct accesses.

        ``above`` are scores that other shards have reached: what lies strictly below the kth of all may be left out.
        """
        there = (self.size[own] > 0) & (weight > 0)
        own, weight = own[there], weight[there]
        none = np.zeros(0, np.int64)
        if not len(own):
            return none, none, 0
        size, start = self.size[own], self.start[own]
        longest = int(size.max())
        seen = np.zeros((len(own), longest + 1), bool)
        met = np.zeros(self.n_docs, bool)
        rows = np.arange(len(own))[:, None]
        docs, scores, accesses, depth, step = none, none, 0, 0, FIRST
        while depth < longest:
            at = np.arange(depth, min(depth + step, longest))
            inside = at < size[:, None]
            read = self.doc[(start[:, None] + at)[inside]]
            new = np.unique(read[~met[read]])
            met[new] = True
            pairs = np.ix_(own, new)
            position = self.position[pairs]
            score = weight @ self.impact_of[pairs].astype(np.int64)
            accesses += position.size
            held = position >= 0
            seen[np.broadcast_to(rows, position.shape)[held], position[held]] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= kth
                docs, scores = docs[near], scores[near]
                order = np.lexsort((place[docs], -scores))[:k]
                docs, scores = docs[order], scores[order]
            best = seen.argmin(1)  # the first position that is not seen
            bound = int(weight @ np.where(best < size, self.impact[start + best - 1], 0).astype(np.int64))
            all_scores = np.concatenate([scores, above])
            if len(all_scores) >= k and bound < np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]:
                break
            depth, step = depth + step, 2 * step
        good = scores > 0
        return docs[good], scores[good], accesses


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of a term that occurs ``counts`` times in a document of ``lengths`` terms, without its weight."""
    m = 100 - SHARE + (SHARE * lengths * n_docs) // n_terms
    return (UNIT * counts) // (SLOPE * counts + BASE * m)


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def _searched(vectors: DataFrame, queries: Any, n_docs: int, n_terms: int, k: int, shard: int) -> DataFrame:
    """``query, doc_id, score``: the ``k`` best of each task for each query. ``queries`` is a broadcast list of (terms, weights)."""
    id_field = vectors.schema["doc_id"]
    schema = StructType([StructField("query", IntegerType()), id_field, StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        every = np.unique(np.concatenate([t for t, _ in asked])) if asked else np.zeros(0, np.int64)
        best: list[list[tuple[int, bool, Any]]] = [[] for _ in asked]  # (-score, is null, id), in order
        kind = None
        size = max(1, min(shard, CELLS // max(1, len(every))))
        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for a in range(0, whole.num_rows, size):
                _shard_results(whole.slice(a, size), asked, every, best, n_docs, n_terms, k)
        rows = [(q, x[2], -x[0]) for q, found in enumerate(best) for x in found]
        if rows:
            q, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


def _shard_results(batch: pa.RecordBatch, asked: list, every: np.ndarray, best: list, n_docs: int, n_terms: int, k: int) -> None:
    """Take one shard's documents into ``best``."""
    ids, n, lists, counts = batch.columns
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    term = np.searchsorted(every, lists.flatten().to_numpy())
    tf = counts.flatten().to_numpy()
    lengths = n.to_numpy()
    made = Shard(term, doc, impacts(tf, lengths[doc], n_docs, n_terms), len(every), len(size))
    place = np.empty(len(size), np.int64)
    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(size))
    for q, (own, weights) in enumerate(asked):
        above = np.array([-x[0] for x in best[q]], np.int64)
        docs, scores, _ = made.best(np.searchsorted(every, own), weights, place, k, above)
        if len(docs):
            found = [(-s, (v := ids[d].as_py()) is None, v) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
            best[q] = sorted(best[q] + found, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:k]


def _block(docs: DataFrame, asked: list[Row], first: int, k: int, shard: int) -> DataFrame | None:
    """``__item, rank, doc_id, score`` for one block of items; None if none has a term."""
    sc = docs.sparkSession.sparkContext
    counted = [terms(r.text) for r in asked]
    number = {w: i for i, w in enumerate(sorted(set().union(*counted)))} if counted else {}
    if not number:
        return None
    vectors = docs.select("doc_id", _vectors(F.col("text"), sc.broadcast(number)).alias("v")).select("doc_id", "v.*").where("n > 0")
    vectors = materialize(vectors, "vectors")
    whole = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not whole.docs:
        return None
    # a row for each term of the block
    holding = {r.t: r.n for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator()}
    queries = []
    for found in counted:
        own = sorted((number[w], c) for w, c in found.items() if number[w] in holding)
        queries.append((np.array([t for t, _ in own], np.int64), np.array([c * weight(whole.docs, holding[t]) for t, c in own], np.int64)))
    met = _searched(vectors.where(F.size("terms") > 0), sc.broadcast(queries), whole.docs, whole.terms, k, shard)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select((F.col("query") + first).alias("__item"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = ITEMS, shard: int = SHARD) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    queries = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    schema = StructType([StructField("__item", IntegerType()), queries.schema["item_id"]])
    out = None
    rows, first = queries.toLocalIterator(), 0
    while asked := list(islice(rows, block)):
        if (found := _block(source, asked, first, k, shard)) is not None:
            names = spark.createDataFrame([(first + i, r.item_id) for i, r in enumerate(asked)], schema)
            named = found.join(F.broadcast(names), "__item").select("item_id", "rank", "doc_id", "score")  # a block's ids
            out = named if out is None else out.unionByName(named)
        first += len(asked)
    if out is None:
        empty = StructType([queries.schema["item_id"], StructField("rank", IntegerType()), source.schema["doc_id"], StructField("score", LongType())])
        return spark.createDataFrame([], empty)
    return out
