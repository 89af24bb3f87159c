"""Lexical search, vectorised byte-level BPE and the prefix trie against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.llm import byte_bpe, prefix_trie, search

# --- ranked search


def plain_search(docs, items, k=10):
    own = {i: Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for i, (_, t) in enumerate(docs)}
    own = {i: c for i, c in own.items() if c}
    n_docs, n_terms = len(own), sum(c.total() for c in own.values())
    df = Counter(w for c in own.values() for w in c)
    out = []
    for item, text in items:
        asked = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        scored = []
        for i, c in own.items():
            m = 25 + (75 * c.total() * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in asked.items() if c[w])
            if s > 0:
                scored.append((-s, docs[i][0] is None, docs[i][0] or 0, docs[i][0]))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("shard", [3, 4096])
def test_search_equals_plain_scores(spark, shard):
    r = random.Random(shard)
    words = ["the", "The", "über", "ÜBER", "x1", "Rare%d", "漢字", "of", "and", "zeta", "eta"]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(words).replace("%d", str(r.randrange(9))) for _ in range(n))
    docs = [(i, text(r.randrange(1, 30)), "u") for i in range(150)]
    docs += [(500 - i, "the the zeta", "u") for i in range(30)]  # copies: equal scores
    docs += [(900, None, "u"), (901, "", None), (902, " .,;", None), (None, "the zeta", "u"), (903, "zeta " * 20_000, "u"), (3, "zeta eta", "u"), (3, "zeta eta", "u")]
    items = [(i, text(r.randrange(1, 12))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, ""), (None, "zeta the"), (23, "zeta zeta the"), (23, "eta")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = search.search(df, spark.createDataFrame(items, "item_id long, text string"), shard=shard, block=7).collect()
    plain = plain_search([d[:2] for d in docs], items)
    assert Counter(map(tuple, got)) == Counter(plain)
    assert len(got) > 100


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in search.search(docs, items).collect()] == [(1, 1, 1)] or search.weight(1, 1) == 0


def test_best_positions_stop_early_and_right():
    rng = np.random.default_rng(1)
    n, lists = 3000, 4
    own = [np.unique(rng.integers(0, n, 1500)) for _ in range(lists)]
    doc = np.concatenate(own)
    term = np.repeat(np.arange(lists), [len(x) for x in own])
    impact = rng.integers(1, 1_000_000, len(doc))
    impact[doc == 77] = 999_999  # one that leads everywhere
    made = search.Shard(term, doc, impact, lists, n)
    weight = np.array([5, 3, 2, 7])
    whole = weight @ made.impact_of.astype(np.int64)
    for k in (1, 10):
        docs, scores, accesses = made.best(np.arange(lists), weight, np.arange(n), k, np.zeros(0, np.int64))
        order = np.lexsort((np.arange(n), -whole))[:k]
        assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        assert accesses < lists * n
    _, _, fewer = made.best(np.arange(lists), weight, np.arange(n), 1, np.array([int(weight.sum()) * 1_000_000]))
    assert fewer <= lists * lists * search.FIRST  # another shard's score ends it in the first round


# --- byte-level BPE


def ranks_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "ß", "1", "²", "漢", "!", "...", " ", " ", "\x85", "\x1c", "\x00", "😀", "s", "re", "l", "ͅ", "\U00010d40", "Ᲊ", "<|endoftext|>"]


def test_slices_are_those_of_the_library(library):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 3000, "'s" * 999, "x" * 70 + " " * 70 + "y", *[chr(c) + "'s" for c in range(0x250)]]
    coder = byte_bpe.coder(ranks_path())
    got = list(coder.encode(texts))
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [coder.ranks.decoded(g) for g in got] == [t.encode() for t in texts]
    short = [next(coder.encode([t], stretch=5)).tolist() for t in texts[:400]]
    assert short == [g.tolist() for g in got[:400]]


def test_scan_is_the_same_for_any_layout():
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 9, 5000).astype(np.uint8)
    state, begins = 0, []
    for c in kinds:
        begins.append(bool(byte_bpe._BEGINS[state, c]))
        state = int(byte_bpe._FOLLOWING[state, c])
    for rows in (1, 7, 64, 4096):
        marked, last = byte_bpe.scan(kinds, 0, rows)
        assert marked.tolist() == begins and last == state


def test_byte_bpe_round_trip_of_a_table(spark, library):
    rows = [(1, "It's  a test's end. ", "x"), (1, "It's  a test's end. ", "x"), (None, "é 漢字12ab", "x"), (3, None, "x"), (4, "", "x"), (5, "word's 12 " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encoded_documents(df, ranks_path()).collect()}
    want = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert byte_bpe.encoded_documents(df.limit(0), ranks_path()).collect() == []
    coded = df.select("text", byte_bpe.encode(F.col("text"), ranks_path()).alias("e")).select("text", "e.ids", "e.offsets", byte_bpe.decode(F.col("e.ids"), ranks_path()).alias("raw"))
    for r in coded.collect():
        assert bytes(r.raw) == (r.text or "").encode() and r.offsets[-1] == len(r.raw) and len(r.offsets) == len(r.ids) + 1


# --- prefix trie


def plain_trie(rows, mixed):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:2])] for c, vs in convs.items()}
    seq = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:]) if mixed else tuple(v)
    nodes, kids = {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = Counter(), Counter()
    for s, m in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * w
            leaves[s[:d]] += s not in kids
    out = []
    for s, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if seq[c] == s)))
        out.append((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("shard", [2, 1 << 17])
@pytest.mark.parametrize("mixed", [False, True])
def test_trie_equals_a_plain_one(spark, shard, mixed):
    r = random.Random(shard + mixed)
    rows = []
    for c in range(70):  # many begin alike; some are prefixes or copies of others
        for t in range(r.randrange(1, 6)):
            rows.append((c, t if t else r.choice([0, None]), r.choice(["user", "user", None, ""]), r.choice(["hello you", "hello you", "a b c", "", None, "x " * 40])))
    rows += [(200 + c, 0, "user", "hello you") for c in range(40)]  # one large group of copies
    rows += [(k, t, "user", "hello you") for k in (301, 302) for t in range(30)]
    rows += [(None, 0, "user", "hello you"), (341, 0, "user", "only"), (362, 5, "u", "gone")]
    df = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA)
    got = sorted((tuple(x) for x in prefix_trie.prefix_trie(df, mixed, shard).collect()), key=str)
    assert got == plain_trie(rows, mixed)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), True).collect() == []


def test_parentheses_close_where_a_stack_says():
    r = random.Random(1)
    for size in (1, 5, 200, 3000):
        signs, depth = [], 0
        while len(signs) < size or depth:
            up = len(signs) < size and (depth == 0 or r.random() < 0.55)
            signs.append(1 if up else -1)
            depth += signs[-1]
        stack, close = [], {}
        for i, s in enumerate(signs):
            if s > 0:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(np.array(signs) > 0)
        for block in (4, 64):
            assert prefix_trie.Excess(np.array(signs, np.int8), block).find_close(opens, 100).tolist() == [close[i] for i in opens.tolist()]


# --- recall of the sketches


def _edited(rng, words, kind, how, share):
    n = len(words)
    k = max(1, round(share * n))
    at = set(rng.sample(range(n), k)) if how == "scattered" else set(range(s := rng.randrange(n - k + 1), s + k))
    out = []
    for i, w in enumerate(words):
        if i in at and kind == "deleted":
            continue
        if i in at:
            out.append(rng.getrandbits(60))
        if i not in at or kind == "inserted":
            out.append(w)
    return out


@pytest.mark.parametrize("kind", ["deleted", "inserted", "substituted"])
@pytest.mark.parametrize("how", ["scattered", "together"])
def test_sketches_meet_at_the_threshold(kind, how):
    """Pairs of 20 to 2,000 words with a similarity of 0.8 to 0.9: at least 0.9 share a sketch, at every length alike."""
    from eventmill.llm import minhash

    rng = random.Random(4)
    met = pairs = 0
    for n in (20, 30, 60, 200, 600, 2000):
        for _ in range(25):
            words = [rng.getrandbits(60) for _ in range(n)]
            similar = rng.uniform(0.8, 0.9)
            share = {"deleted": 1 - similar, "inserted": 1 / similar - 1, "substituted": (1 - similar) / (1 + similar)}[kind]
            x, y = (np.array(v, np.uint64) for v in (words, _edited(rng, words, kind, how, share)))
            if minhash.aligned(x, y)[0]:
                pairs += 1
                met += bool(np.intersect1d(minhash.sketch(minhash.kmers(x)), minhash.sketch(minhash.kmers(y))).size)
    assert pairs > 60 and met >= 0.9 * pairs, (met, pairs)


# --- toxicity


def test_severities_equal_a_plain_evaluation(spark):
    """Fitted on labelled rows, then each text scored by hand: features once each, three thresholds, expected severity."""
    from eventmill.llm import toxicity

    rng = random.Random(2)
    clean, bad = [f"word{k}" for k in range(300)], [f"vile{k:02d}x" for k in range(12)]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        text = [rng.choice(clean) for _ in range(30)] + ([rng.choice(bad) for _ in range(rng.randint(2, 9))] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).title(), "s"))
        labels.append((i, int(toxic)))
    # \u03a3 at the end of a word is lower-cased by what follows, so slices must not be lower-cased for themselves
    long = "\u0391" * 999_999 + "\u03a3.\u0391 VILE01X " + "word3 " * 50_000
    rows += [(900, None, "s"), (901, "", "s"), (902, "...", "s"), (903, long, "s"), (None, "vile01x vile02x vile03x", "s"), (0, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_documents(docs.where("doc_id <> 0 OR severity IS NOT NULL"), known)
    assert model.weights and min(model.weights.values()) > 0 and model.thresholds == sorted(model.thresholds)

    def plain(text):
        found = set(re.findall(r"\w+", (text or "").lower()))
        score = sum(model.weights.get(f, 0.0) for w in found for f in [w, *[f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) >= k]])
        up = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        each = [1 - up[0], up[0] - up[1], up[1] - up[2], up[2]]
        return round(sum(k * p for k, p in enumerate(each)), 9), each.index(max(each)), round(up[0], 9), up[0] >= toxicity.DECISION

    told = docs.select("doc_id", toxicity.predict(F.col("text"), model, spark).alias("p")).select("doc_id", "p.*").collect()
    got = Counter((r.doc_id, round(r.severity, 9), r.grade, round(r.p_toxic, 9), r.p_toxic >= toxicity.DECISION) for r in told)
    assert got == Counter((i, *plain(t)) for i, t, _ in rows)
    assert toxicity.words(long) == set(re.findall(r"\w+", long.lower()))
    whole = toxicity.severities(docs, known)
    assert whole.count() == len(rows) and toxicity.severities(docs.limit(0), known).collect() == []
    caught = {r.doc_id for r in whole.where("toxic").collect()}
    assert len(caught & {i for i, y in labels if y}) >= 36 and not caught & {i for i, y in labels if not y}
