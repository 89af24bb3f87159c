"""The trie of conversation prefixes, as balanced parentheses in shards.

A conversation is the sequence of its turns' 128-bit digests, laid end to end as one binary
``path``; binary order is then the order of a depth-first walk through the trie. Conversations
are range-partitioned and sorted by path and id, and a task cuts its partition into shards of
bounded size. A shard writes its piece of the trie as balanced parentheses: from one
conversation to the next, a closing parenthesis for each turn left and an opening one for each
turn entered. Blocks of the excess (opening less closing parentheses so far) with their least
and greatest values, in a binary tree, let ``find_close`` delimit the subtrees of all nodes
at once. Inside these bounds the rank of ``()`` pairs counts leaves, and cumulative arrays give
members and savings.

Neighbouring shards share the spine of nodes between them. A shard knows the last path before
it and the first one behind it, so it counts a shared node as new only where it begins and a
leaf only where it ends; all that a shared node reports then adds up over its shards, and
shared spines merge by one sum for each node. Its parts are a row a shard, however many
conversations begin alike.

The digest of the conversations that end at a node is one SHA-256 over their ids: inside a
shard it is taken at once; over several shards it reads one text of ids a shard, in order,
holding one at a time. (SHA-256 has no parallel form: the ids of one node pass through one task.)

Defined results: a null role or text counts as empty; turns are ordered by number, nulls
first, turns of one number by digest; a repeated turn is a turn like others; rows without a
conversation id belong to no conversation and are left out; an empty table gives no rows, not
even a root; further columns are ignored. A conversation's digests, 24 bytes a turn, stand in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.plans.scratch import materialize
from eventmill.plans.skew import partitions

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of a shard at most, but for a longer conversation.
SHARD = 1 << 17
#: Parentheses of a block.
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"

_EMPTY = hashlib.sha256(b"").hexdigest()
_BLOB = "part int, k int, first binary, last binary, ids binary, sizes binary, paths binary, words binary"
_NODE = (
    "part int, k int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string"
)


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, with digest (hex) and words."""
    role_of, text_of = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of), 256), 1, 2 * WIDTH)
    rows = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(text_of, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _path(turns_col: Column) -> dict[str, Column]:
    return {"path": F.unhex(F.array_join(F.transform(turns_col, lambda t: t.digest), "")), "words": F.transform(turns_col, lambda t: t.words)}


def sequences(told: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of conversations as they are."""
    return told.select("conv_id", *[c.alias(k) for k, c in _path(F.col("turns")).items()])


def rebuilt(told: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, path, words`` where each conversation begins with h turns of its family's first one.

    The family of conversation c is c - c % ``family``, h is crc32 of the decimal c modulo ``most``.
    At most ``family`` conversations join one.
    """
    own = told.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("of"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int").alias("h"))
    heads = told.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.join(heads, "of", "left")
    begun = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(begun, rest).alias("turns")).select("conv_id", *[c.alias(k) for k, c in _path(F.col("turns")).items()])


def _shards(paths: DataFrame, shard: int) -> DataFrame:
    """Sorted conversations, a row for each shard: packed arrays with the first and the last path."""
    total = paths.agg(F.sum(F.greatest(F.size("words"), F.lit(1)))).first()[0] or 0
    parts = max(partitions(paths), -(-total // shard))
    dealt = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def packed(part: int, k: int, rows: list[tuple]) -> dict:
        ids, path, words = zip(*rows, strict=True)
        sizes = np.array([len(w) for w in words], "<i8")
        return {
            "part": part, "k": k, "first": path[0], "last": path[-1], "ids": np.array(ids, "<i8").tobytes(), "sizes": sizes.tobytes(),
            "paths": b"".join(path), "words": np.concatenate([np.asarray(w, "<i8") for w in words]).tobytes(),
        }

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, rows, held = None, 0, [], 0
        for b in batches:
            part = int(b["part"].iloc[0]) if part is None and len(b) else part
            for conv, path, words in zip(b["conv_id"].tolist(), b["path"].tolist(), b["words"].tolist(), strict=True):
                if rows and held + len(words) > shard:
                    yield pd.DataFrame([packed(part, k, rows)])
                    k, rows, held = k + 1, [], 0
                rows.append((conv, bytes(path), words))
                held += max(1, len(words))
        if rows:
            yield pd.DataFrame([packed(part, k, rows)])

    return materialize(dealt.withColumn("part", F.spark_partition_id()).mapInPandas(cut, _BLOB), "shards")


def common_turns(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(1))
    return int(differ[0]) if len(differ) else n


def neighbour_prefixes(digests: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of each sequence with the one before it; 0 for the first."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    both = np.minimum(sizes[1:], sizes[:-1])
    start = np.concatenate([[0], np.cumsum(both)])
    pair = np.repeat(np.arange(len(both)), both)
    inside = np.arange(start[-1]) - start[pair]
    differ = np.flatnonzero((digests[at[pair] + inside] != digests[at[pair + 1] + inside]).any(1))
    first = np.append(differ, start[-1])[np.searchsorted(differ, start[:-1])]
    return np.concatenate([[0], np.minimum(first - start[:-1], both)]).astype(np.int64)


def parentheses(sizes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """1 and -1 for the opening and closing parentheses of the trie, root included, of sorted sequences."""
    counts = np.zeros(2 * len(sizes) + 2, np.int64)
    counts[0] = 1
    counts[3:-1:2] = sizes[:-1] - common[1:]
    counts[2:-1:2] = sizes - common
    counts[-1] = sizes[-1] + 1
    return np.repeat(np.tile(np.array([1, -1], np.int8), len(sizes) + 1), counts)


class Excess:
    """Least and greatest excess of each block, in a binary tree."""

    def __init__(self, signs: np.ndarray, block: int = BLOCK):
        self.block = block
        n = -(-len(signs) // block)
        n = 1 << max(0, (n - 1).bit_length())
        outside = np.int64(1 << 60)
        values = np.full(n * block, outside)
        values[: len(signs)] = np.cumsum(signs, dtype=np.int64)
        self.values = values.reshape(n, block)
        filled = np.where(self.values == outside, -outside, self.values)
        self.least, self.greatest = [self.values.min(1)], [filled.max(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
            self.greatest.append(self.greatest[-1].reshape(-1, 2).max(1))

    def _holds(self, level: int, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (self.least[level][at] <= wanted) & (wanted <= self.greatest[level][at])

    def find_close(self, opens: np.ndarray, most: int = 1 << 14) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        return np.concatenate([self._closes(opens[a : a + most]) for a in range(0, len(opens), most)])

    def _closes(self, opens: np.ndarray) -> np.ndarray:
        lane = np.arange(self.block)
        own = opens // self.block
        wanted = self.values.ravel()[opens] - 1
        here = (self.values[own] == wanted[:, None]) & (lane > (opens % self.block)[:, None])
        out = own * self.block + here.argmax(1)
        left = np.flatnonzero(~here.any(1))
        if not len(left):
            return out
        # upwards until a right neighbour holds the value
        at, level = own[left], np.full(len(left), -1)
        wanted = wanted[left]
        for k in range(len(self.least) - 1):
            going = np.flatnonzero(level < 0)
            right = at[going] + 1
            turn = (at[going] % 2 == 0) & self._holds(k, np.minimum(right, len(self.least[k]) - 1), wanted[going])
            at[going[turn]], level[going[turn]] = right[turn], k
            at[going[~turn]] //= 2
        # and down to the first block that holds it
        for k in range(len(self.least) - 1, 0, -1):
            going = np.flatnonzero(level == k)
            child = 2 * at[going]
            at[going] = np.where(self._holds(k - 1, child, wanted[going]), child, child + 1)
            level[going] = k - 1
        out[left] = at * self.block + (self.values[at] == wanted[:, None]).argmax(1)
        return out


def _least_of_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each range low <= i < high, none empty, by the minima of stretches of powers of two."""
    tables = [values]
    while 2 ** len(tables) <= len(values):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    out = np.empty(len(low), values.dtype)
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    for p, stretch in enumerate(tables):
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(stretch[low[at]], stretch[high[at] - 2**p])
    return out


def _digests(path: bytes) -> np.ndarray:
    return np.frombuffer(path, "<u8").reshape(-1, 2)


def _spine(path: bytes, most: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``most`` turns."""
    h, out = hashlib.sha256(), []
    for d in range(most + 1):
        out.append(h.copy().digest()[:WIDTH])
        h.update(path[d * WIDTH : (d + 1) * WIDTH])
    return out


def shard_nodes(ids: np.ndarray, sizes: np.ndarray, paths: bytes, words: np.ndarray, before: bytes | None, behind: bytes | None) -> dict[str, list | np.ndarray]:
    """The nodes of one shard in preorder; those shared with a neighbour have a ``key`` and only this shard's part of each figure."""
    digests = _digests(paths)
    at = np.concatenate([[0], np.cumsum(sizes)])
    common = neighbour_prefixes(digests, sizes)
    entered = sizes - common
    signs = parentheses(sizes, common)
    opens = np.flatnonzero(signs > 0)
    closes = Excess(signs).find_close(opens)
    n = len(opens)
    end = np.arange(n) + (closes - opens + 1) // 2  # the node behind each subtree, in preorder
    conv = np.concatenate([[0], np.repeat(np.arange(len(sizes)), entered)])
    first_of = np.cumsum(entered) - entered + 1
    depth = np.concatenate([[0], np.arange(1, n) - np.repeat(first_of, entered) + np.repeat(common, entered) + 1])
    own_words = np.concatenate([[0], words[at[conv[1:]] + depth[1:] - 1]]).astype(np.int64)

    # the spines shared with the neighbours
    first, last = paths[: int(sizes[0]) * WIDTH], paths[int(at[-2]) * WIDTH :]
    left = -1 if before is None else common_turns(_digests(before), _digests(first))
    right = -1 if behind is None else common_turns(_digests(last), _digests(behind))
    begun = (conv == 0) & (depth <= left)  # not new here
    goes_on = (end == n) & (depth <= right)
    keys: list[bytes | None] = [None] * n
    for shared, path, most in ((begun, first, left), (goes_on, last, right)):
        names = _spine(path, most)
        for v in np.flatnonzero(shared).tolist():
            keys[v] = names[depth[v]]

    leaf = np.zeros(len(signs), np.int64)
    leaf[:-1] = (signs[:-1] > 0) & (signs[1:] < 0)
    if right == sizes[-1]:  # what follows goes on from the last node, or ends there too
        leaf[opens[-1]] = 0
    rank = np.concatenate([[0], np.cumsum(leaf)])
    ends_at = np.maximum.accumulate(np.where(entered > 0, np.cumsum(entered), 0))  # the node at which each conversation ends
    low, high = np.searchsorted(ends_at, np.arange(n)), np.searchsorted(ends_at, end)
    members = high - low
    total = np.concatenate([[0], np.cumsum((members - ~begun) * own_words)])

    order = np.lexsort((np.arange(n), depth))
    place = depth[order] * (n + 1) + order
    parent = order[np.searchsorted(place, (depth - 1) * (n + 1) + np.arange(n)) - 1]
    parent[0] = 0
    children = np.bincount(parent[1:][~begun[1:]], minlength=n)
    least = _least_of_ranges(ids, low, high)

    sha, chunks = [_EMPTY] * n, [None] * n
    stops = np.flatnonzero(np.diff(ends_at, append=n))
    for a, b in zip([0, *(stops[:-1] + 1).tolist()], (stops + 1).tolist(), strict=True):
        joined = ",".join(map(str, ids[a:b].tolist()))
        v = int(ends_at[a])
        if keys[v] is None:
            sha[v] = hashlib.sha256(joined.encode()).hexdigest()
        else:
            chunks[v] = joined
    parents = parent.tolist()
    return {
        "key": keys, "parent_key": [None, *[keys[p] for p in parents[1:]]], "depth": depth, "conv_id": least,
        "parent_conv_id": pd.array([None, *[int(least[p]) if keys[p] is None else None for p in parents[1:]]], dtype="Int64"),
        "n_convs": members, "n_children": children, "n_leaves": rank[closes] - rank[opens], "saved_tokens": total[end] - total[:-1],
        "ends_sha256": sha, "ends": chunks,
    }


def _nodes(blobs: DataFrame) -> DataFrame:
    """The nodes of every shard, each shard with its neighbours' paths."""
    w = Window.orderBy("part", "k")  # a row a shard
    near = blobs.select("part", "k", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("behind"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, sizes, words = (np.frombuffer(x, "<i8") for x in (r.ids, r.sizes, r.words))
                told = shard_nodes(ids, sizes, bytes(r.paths), words, r.before, r.behind)
                yield pd.DataFrame({"part": r.part, "k": r.k} | told)

    joined = blobs.drop("first", "last").join(near, ["part", "k"])
    return materialize(joined.mapInPandas(read, _NODE), "nodes")


def _digest_of_parts(parts: DataFrame) -> DataFrame:
    """``key, ends_sha256`` over each key's ``ends`` in the order of shards, one part in memory at a time."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h, done = None, None, []
        for b in batches:
            for k, text in zip(b["key"], b["ends"], strict=True):
                if k != key:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
            done = []
        if h:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])

    ordered = parts.repartition("key").sortWithinPartitions("key", "part", "k").select("key", "ends")
    return ordered.mapInPandas(streamed, "key binary, ends_sha256 string")


def trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row for each node of the trie of ``conv_id, path, words``; ``conv_id`` is unique.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    nodes = _nodes(_shards(materialize(paths, "paths"), shard))
    whole, shared = nodes.where("key IS NULL"), nodes.where("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = materialize(shared.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums), "merged")
    # what a shard's own nodes need of the spine is looked up by shard: a parent with very many children is a row in each
    local = materialize(shared.select("part", "k", "key").join(merged.select("key", "conv_id"), "key").select("part", "k", F.col("key").alias("parent_key"), F.col("conv_id").alias("of_shared")), "local")
    parent = F.coalesce("parent_conv_id", "of_shared").alias("parent_conv_id")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    hung = whole.join(local, ["part", "k", "parent_key"], "left").select("conv_id", "depth", parent, *figures, "ends_sha256")
    spine_parents = shared.select("part", "k", "key", "parent_key").join(local, ["part", "k", "parent_key"]).groupBy("key").agg(F.first("of_shared").alias("parent_conv_id"))
    digests = _digest_of_parts(shared.where("ends IS NOT NULL").select("key", "part", "k", "ends"))
    spine = merged.join(spine_parents, "key", "left").join(digests, "key", "left")
    spine = spine.select("conv_id", "depth", "parent_conv_id", *figures, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    return hung.unionByName(spine)


def prefix_trie(conversations: DataFrame, mixed: bool = False, shard: int = SHARD, **columns: str) -> DataFrame:
    """``trie`` of a table of turns; ``mixed`` gives conversations the beginnings of ``rebuilt``."""
    told = turns(conversations, **columns)
    return trie(rebuilt(materialize(told, "turns")) if mixed else sequences(told), shard)
