"""Language identification by a linear-chain conditional random field over words.

States are the languages of the training labels. A word scores each state by the sum of
weights of its features: the word, prefixes and suffixes, character n-grams, and the
lexicons (frequent words of each language in the sample) that hold it. Transitions are
learned on sequences that switch language, joined from windows of labelled documents.
Forward-backward gives each word's posterior; a document gets the language with the most
posterior mass, and the mean posterior of that language as its score. ``sure`` is the mean
over words of each word's largest posterior: switching language does not lower it.

Training reads a bounded sample of labelled rows: about ``SAMPLE`` documents for each
language, chosen by a hash of the id over all rows, and ``WINDOW`` words of each from a
place that the hash gives. Prediction reads whole texts and nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score and ``sure`` 0; so is
every text if no training row has a label. Ties go to the language that sorts first. Repeated
rows, null ids and null labels are rows like others (a null id is not held out); an empty table
gives no rows; further columns are ignored, and ``keep_known`` returns them unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.llm.texts import pieces

UND = "und"
SAMPLE, WINDOW, LEXICON = 250, 160, 150
BUCKETS = 1 << 17
EPOCHS, RATE, DECAY = 4, 0.3, 1e-4

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"[\W\d_]")


#: Letters from which a word's features are summed in steps, so that memory stays bounded.
LONG_WORD, STEP = 1000, 50_000
#: Words whose scores a worker remembers, words and letters whose features are listed at once, and words of texts that are told at once.
REMEMBERED, LISTED, LETTERS, TOLD = 100_000, 5_000, 100_000, 100_000


def _parts(word: str, lexicons: dict[str, int]) -> Iterator[str]:
    n = len(word)
    yield "w" + word
    for k in range(1, min(3, n) + 1):
        yield "p" + word[:k]
        yield "s" + word[-k:]
    edged = f"<{word}>"
    for k in range(n):
        yield edged[k : k + 3]
    for k in range(n - 1):
        yield word[k : k + 2]
    held = lexicons.get(word, 0)
    for k in range(held.bit_length()):
        if held >> k & 1:
            yield f"x{k}"


def word_features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Hashed features of the whole word; ``lexicons`` gives a word a bit set of the languages whose lexicon holds it."""
    return [crc32(p.encode("utf-8", "replace")) % BUCKETS for p in _parts(word, lexicons)]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


class _Letters:
    """The letters of a string as the bytes that ``crc32`` reads, for many checksums at once."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (c >= 0x80).astype(np.int64) + ((c >= 0x800) & (c >> 11 != 0x1B)) + (c >= 0x10000)
        size[c >> 11 == 0x1B] = 1  # a surrogate is read as "?"
        self.size, self.begins = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)

    def read(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The states of checksums after the letters ``at``."""
        begins, size = self.begins[at], self.size[at]
        state = _CRC[(state ^ self.bytes[begins]) & 255] ^ state >> 8
        for k in range(1, int(size.max(initial=1))):
            more = np.flatnonzero(size > k)
            state[more] = _CRC[(state[more] ^ self.bytes[begins[more] + k]) & 255] ^ state[more] >> 8
        return state


def features_of(words: list[str], lexicons: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of each word one after the other, and where they end."""
    n = np.array([len(w) for w in words], np.int64)
    letters = _Letters("".join(f"<{w}>" for w in words) + "ps")
    first, last = np.cumsum(n + 2) - n - 1, np.cumsum(n + 2) - 2
    places = np.arange(len(letters.size))
    one = letters.read(np.full(len(places), 0xFFFFFFFF, np.uint32), places)
    two = letters.read(one[:-1], places[1:])
    three = letters.read(two[:-1], places[2:])

    held = [lexicons.get(w, 0) for w in words]
    edges, pairs = np.minimum(n, 3), np.maximum(n - 1, 0)
    sizes = 1 + 2 * edges + n + pairs + np.array([h.bit_count() for h in held], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    out[begins] = [crc32(f"w{w}".encode("utf-8", "replace")) ^ 0xFFFFFFFF for w in words]
    head = np.full(len(words), one[-2])
    for k in range(3):
        long = np.flatnonzero(n > k)
        head[long] = letters.read(head[long], first[long] + k)
        tail = np.full(len(long), one[-1])
        for j in range(k, -1, -1):
            tail = letters.read(tail, last[long] - j)
        out[begins[long] + 1 + 2 * k], out[begins[long] + 2 + 2 * k] = head[long], tail
    for to, count, source, at in ((begins + 1 + 2 * edges, n, three, first - 1), (begins + 1 + 2 * edges + n, pairs, two, first)):
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(to, count) + step] = source[np.repeat(at, count) + step]
    out ^= np.uint32(0xFFFFFFFF)
    for j, h in enumerate(held):
        if h:
            own = [crc32(f"x{k}".encode()) for k in range(h.bit_length()) if h >> k & 1]
            out[ends[j] - len(own) : ends[j]] = own
    return (out % BUCKETS).astype(np.int64), ends


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # from x to, log weights
    starts: np.ndarray
    lexicons: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores of each word by language."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, ends = features_of([w if len(w) < LONG_WORD else "" for w in words], self.lexicons)
        scores = np.add.reduceat(self.weights[flat], np.concatenate([[0], ends[:-1]]), axis=0)
        scores = scores / np.sqrt(np.diff(ends, prepend=0))[:, None]
        for k, w in enumerate(words):
            if len(w) >= LONG_WORD:
                scores[k] = self._long(w)
        return scores

    def _long(self, word: str) -> np.ndarray:
        total, count, hashes = np.zeros(len(self.languages)), 0, (crc32(p.encode("utf-8", "replace")) % BUCKETS for p in _parts(word, self.lexicons))
        while step := list(islice(hashes, STEP)):
            total += self.weights[step].sum(0, dtype=np.float64)
            count += len(step)
        return total / np.sqrt(count)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-30)


def _peaked(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.max(-1, keepdims=True), 1e-300)


def posteriors(scores: np.ndarray, heads: np.ndarray, moves: np.ndarray, starts: np.ndarray, steps: int = 256) -> np.ndarray:
    """Each word's chances of the states, by ``messages``."""
    ahead, behind = messages(scores, heads, moves, starts, steps)
    return _normal(_peaked(ahead * behind))


def expected_moves(scores: np.ndarray, heads: np.ndarray, moves: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Sum over neighbours of one sequence of the chance of each pair of states, from their messages."""
    inner = ~heads[1:]
    then = _peaked(np.exp(scores - scores.max(1, keepdims=True)) * behind)
    pairs = _peaked(ahead)[:-1][inner][:, :, None] * np.exp(moves - moves.max())[None] * then[1:][inner][:, None, :]
    return (pairs / np.maximum(pairs.sum((1, 2), keepdims=True), 1e-300)).sum(0)


def messages(scores: np.ndarray, heads: np.ndarray, moves: np.ndarray, starts: np.ndarray, steps: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each word, up to a factor, over many sequences laid end to end.

    ``heads`` marks their first words. The forward message holds the word's own score, the backward one does not.

    The words are dealt into columns of ``steps``. Products of the step matrices carry
    the messages over columns, so the work is vectorised also for one very long text. A
    head replaces the move by the start weights, which cuts the chain there.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((0, k))
    steps = max(1, min(steps, n))
    cols = -(-n // steps)
    e = np.ones((cols * steps, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    head = np.zeros(cols * steps, bool)
    head[:n] = heads
    head[n:] = True
    e, head = e.reshape(cols, steps, k), head.reshape(cols, steps)
    t, s = np.exp(moves - moves.max()), _normal(np.exp(starts - starts.max()))

    cuts = [np.flatnonzero(head[:, j]) for j in range(steps)]
    whole = np.broadcast_to(np.eye(k), (cols, k, k)).copy()  # what a column does to a message
    for j in range(steps):
        moved = (whole.reshape(-1, k) @ t).reshape(cols, k, k)
        if len(cut := cuts[j]):
            moved[cut] = whole[cut].sum(2, keepdims=True) * s
        moved *= e[:, j, None, :]
        if j % 8 == 7 or j == steps - 1:  # emissions are 1 at most: eight steps stay in range
            moved /= np.maximum(moved.max((1, 2), keepdims=True), 1e-300)
        whole = moved

    enter, leave = np.empty((cols, k)), np.empty((cols, k))
    x = np.full(k, 1.0 / k)
    for c in range(cols):
        enter[c] = x
        x = x @ whole[c]
        x /= max(x.max(), 1e-300)
    x = np.ones(k)
    for c in reversed(range(cols)):
        leave[c] = x
        x = whole[c] @ x
        x /= max(x.max(), 1e-300)

    ahead, behind = np.empty((steps, cols, k)), np.empty((steps, cols, k))
    x = enter
    for j in range(steps):
        moved = x @ t
        if len(cut := cuts[j]):
            moved[cut] = x[cut].sum(1, keepdims=True) * s
        moved *= e[:, j]
        if j % 8 == 7:
            moved /= np.maximum(moved.max(1, keepdims=True), 1e-300)
        ahead[j] = x = moved
    x, back = leave, t.T.copy()
    for j in reversed(range(steps)):
        behind[j] = x
        x = x * e[:, j]
        moved = x @ back
        if len(cut := cuts[j]):
            moved[cut] = (x[cut] @ s)[:, None]
        if j % 8 == 0:
            moved /= np.maximum(moved.max(1, keepdims=True), 1e-300)
        x = moved
    return ahead.transpose(1, 0, 2).reshape(-1, k)[:n], behind.transpose(1, 0, 2).reshape(-1, k)[:n]


def _switched(windows: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Sequences of two to four stretches from different windows."""
    stretches = []
    for words, label in windows:
        at = 0
        while at < len(words):
            size = int(rng.integers(15, 60))
            stretches.append((words[at : at + size], label))
            at += size
    order = rng.permutation(len(stretches))
    out, at = [], 0
    while at < len(order):
        size = int(rng.integers(2, 5))
        chosen = [stretches[k] for k in order[at : at + size]]
        out.append(([w for ws, _ in chosen for w in ws], [y for ws, y in chosen for _ in ws]))
        at += size
    return out


def fit(windows: list[tuple[list[str], str]], seed: int = 7) -> Crf | None:
    """A field from labelled windows of words, by AdaGrad on the log-likelihood."""
    windows = [(w, y) for w, y in windows if w]
    languages = sorted({y for _, y in windows})
    if not languages:
        return None
    index = {y: k for k, y in enumerate(languages)}
    lexicons: dict[str, int] = {}
    for y in languages:
        counts = Counter(w for ws, z in windows if z == y for w in ws)
        for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:LEXICON]:
            lexicons[w] = lexicons.get(w, 0) | 1 << index[y]
    k = len(languages)
    model = Crf(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicons)
    rng = np.random.default_rng(seed)
    sequences = _switched([(w, index[y]) for w, y in windows], rng)
    vocabulary = sorted({w for ws, _ in sequences for w in ws})
    at = {w: j for j, w in enumerate(vocabulary)}
    rows = [word_features(w, lexicons) for w in vocabulary]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.fromiter((f for r in rows for f in r), np.int64, ends[-1])
    sizes = np.diff(ends, prepend=0)
    begins, root = ends - sizes, np.sqrt(sizes)
    squares, move_squares, start_squares = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    batch = 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for b in range(0, len(order), batch):
            chosen = [sequences[j] for j in order[b : b + batch]]
            word = np.array([at[w] for ws, _ in chosen for w in ws])
            truth = np.array([y for _, ys in chosen for y in ys])
            heads = np.zeros(len(word), bool)
            heads[np.cumsum([0] + [len(ws) for ws, _ in chosen[:-1]])] = True
            need, inverse = np.unique(word, return_inverse=True)
            held = sizes[need]
            first = np.cumsum(held) - held
            mine = flat[np.repeat(begins[need] - first, held) + np.arange(held.sum())]
            scores = (np.add.reduceat(model.weights[mine], first, axis=0) / root[need, None])[inverse]
            ahead, behind = messages(scores, heads, model.moves, model.starts)
            p = _normal(_peaked(ahead * behind))
            error = -p
            error[np.arange(len(word)), truth] += 1.0
            by_word = np.add.reduceat(error[np.argsort(inverse, kind="stable")], np.searchsorted(np.sort(inverse), np.arange(len(need))), axis=0)
            by_word /= root[need, None]
            order_of = np.argsort(mine, kind="stable")
            features, where = np.unique(mine[order_of], return_index=True)
            step = np.add.reduceat(np.repeat(by_word, held, axis=0)[order_of], where, axis=0).astype(np.float32)
            step -= DECAY * model.weights[features]
            squares[features] += step**2
            model.weights[features] += RATE * step / np.sqrt(squares[features])
            inner = ~heads[1:]
            expected = expected_moves(scores, heads, model.moves, ahead, behind)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1.0)
            step = (seen - expected) / max(1, len(chosen)) - DECAY * model.moves
            move_squares += step**2
            model.moves += RATE * step / np.sqrt(move_squares)
            lead = np.bincount(truth[heads], minlength=k) - p[heads].sum(0)
            start_squares += lead**2
            model.starts += RATE * lead / np.sqrt(start_squares)
    model.weights = model.weights.astype(np.float32)
    return model


def _few(words: list[str]) -> Iterator[list[str]]:
    """``words`` cut so that the features of each part are bounded: ``LISTED`` words and ``LETTERS`` of their letters."""
    first, letters = 0, 0
    for k, w in enumerate(words):
        if k - first == LISTED or letters > LETTERS:
            yield words[first:k]
            first, letters = k, 0
        letters += min(len(w), LONG_WORD)
    if first < len(words):
        yield words[first:]


class _Scores(dict):
    """Word to its row of emissions; rows of new words are filled in batches."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.new, self.letters = model, [], 0
        self.rows = np.zeros((1024, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        self.letters += len(word)
        return at

    def of(self, index: np.ndarray) -> np.ndarray:
        n = len(self)
        if n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(n, len(self.rows)), self.rows.shape[1]), np.float32)])
        at = n - len(self.new)
        for words in _few(self.new):
            self.rows[at : at + len(words)] = self.model.emissions(words)
            at += len(words)
        self.new = []
        return self.rows[index]

    def trim(self) -> None:
        if len(self) > REMEMBERED or self.letters > 20 * REMEMBERED:
            self.clear()
            self.letters = 0


def _words(text: str) -> Iterator[list[str]]:
    """Words in lower case; only numbers are kept of a very long text's words."""
    lower = text.lower()
    for a, b in pieces(lower, _EDGE):
        yield _WORD.findall(lower, a, b)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """For each code point, whether a word can hold it."""
    told = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        told[m.start() : m.end()] = True
    return told


def _placed(text: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """As ``_words``, with the first and the end character of each word in ``text``."""
    lower = text.lower()
    source = None
    if len(lower) != len(text):  # a character's lower case can be two
        source = np.repeat(np.arange(len(text), dtype=np.int32), [len(c.lower()) for c in text])
    for a, b in pieces(lower, _EDGE):
        inside = np.zeros(b - a + 2, bool)
        inside[1:-1] = _in_words()[np.frombuffer(lower[a:b].encode("utf-32-le", "surrogatepass"), "<u4")]
        at = a + np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)  # words are as long as they can be
        if source is not None:
            at = np.stack([source[at[:, 0]], source[at[:, 1] - 1] + 1], axis=1).astype(np.int64)
        yield _WORD.findall(lower, a, b), at


def _runs(p: np.ndarray, at: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of words with one best language; the score is its mean posterior over them."""
    best = p.argmax(1)
    first = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
    sizes = np.diff(np.append(first, len(best)))
    means = np.add.reduceat(p[np.arange(len(best)), best], first) / sizes
    ends = first + sizes - 1
    return [{"start": int(a), "end": int(b), "lang": languages[k], "score": _share(x)} for a, b, k, x in zip(at[first, 0], at[ends, 1], best[first], means)]


def _share(x: float) -> float:
    return float(min(1.0, max(0.0, x)))


def label(texts: Iterable[str | None], model: Crf | None, known: _Scores | None = None, most_words: int = TOLD, runs: bool = False) -> list[tuple]:
    """Language, score and sureness of each text; with ``runs`` also its runs."""
    none = (UND, 0.0, 0.0, []) if runs else (UND, 0.0, 0.0)
    if model is None:
        return [none for _ in texts]
    known = known if known is not None else _Scores(model)
    out: list[tuple] = []
    held: list[np.ndarray] = []
    places: list[np.ndarray] = []

    def flush() -> None:
        sizes = np.array([len(h) for h in held], np.int64)
        index = np.concatenate(held)
        heads = np.zeros(len(index), bool)
        starts = np.cumsum(sizes) - sizes
        heads[starts[sizes > 0]] = True
        p = posteriors(known.of(index), heads, model.moves, model.starts)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        sure = np.concatenate([[0.0], np.cumsum(p.max(1))])
        for j, (a, n) in enumerate(zip(starts, sizes)):
            mass = (total[a + n] - total[a]) / max(1, n)
            best = int(mass.argmax())
            told = (model.languages[best], _share(mass[best]), _share((sure[a + n] - sure[a]) / n)) if n else none
            out.append((*told, _runs(p[a : a + n], places[j], model.languages)) if runs and n else told)
        held.clear()
        places.clear()
        known.trim()

    count = 0
    for text in texts:
        rows, spots = [], [np.zeros((0, 2), np.int64)]
        letters = False
        for ws, at in _placed(text or "") if runs else ((ws, None) for ws in _words(text or "")):
            letters = letters or any(map(str.isalpha, ws)) or any(map(str.isalpha, "".join(ws)))
            rows.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
            if runs:
                spots.append(at)
        if not letters:  # numerals like one half are words without a letter
            rows, spots = [], spots[:1]
        if runs:
            places.append(np.concatenate(spots))
        held.append(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        count += len(held[-1])
        if count >= most_words:
            flush()
            count = 0
    if held:
        flush()
    return out


def training_sample(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> list[tuple[list[str], str]]:
    """Windows of words of about ``sample`` documents for each label, over all of ``docs(key, text, lang)``.

    The bound is ``1.5 * sample`` windows a label; a label's rows come by a hash of their key.
    """
    counts = {r.lang: r.n for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(v) for y, n in sorted(counts.items()) for v in (y, min(1.0, sample / n))])
    chosen = docs.where("text IS NOT NULL").where(draw < share[F.col("lang")])
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))
    spot = F.pmod(F.xxhash64("key", F.lit(12)), F.greatest(F.lit(1), F.size("w") - window + 1)).cast("int") + 1
    rows = chosen.select("key", "lang", words.alias("w")).select("key", "lang", F.slice("w", spot, F.lit(window)).alias("w"))
    got, held = Counter(), []
    for r in sorted(rows.toLocalIterator(), key=lambda r: (str(r.lang), str(r.key))):
        if got[r.lang] < 1.5 * sample:
            got[r.lang] += 1
            held.append((list(r.w), r.lang))
    return held


_known: dict[int, _Scores] = {}


def predict(text: Column, model: Crf | None, spark, runs: bool = False) -> Column:
    """Struct(lang, score, sure) of each text; with ``runs`` also its runs(start, end, lang, score).

    Runs come from the posteriors of the words that the other fields average. ``start`` is the
    first character of a run's first word, counted from 0, and ``end`` the one after its last.
    The model holds ``BUCKETS`` numbers for each label, and there are as many labels as languages.
    """
    shared = spark.sparkContext.broadcast(model)
    run = pa.struct({"start": pa.int32(), "end": pa.int32(), "lang": pa.string(), "score": pa.float64()})
    types = {"lang": pa.string(), "score": pa.float64(), "sure": pa.float64()} | ({"runs": pa.list_(run)} if runs else {})
    fields = ["lang string", "score double", "sure double"] + ["runs array<struct<start:int,end:int,lang:string,score:double>>"] * runs

    @F.arrow_udf(", ".join(fields))
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = shared.value
        if field is not None and id(field) not in _known:
            _known.clear()
            _known[id(field)] = _Scores(field)
        for texts in batches:  # one text is read at a time
            rows = label((t.as_py() for t in texts), field, _known.get(id(field)), runs=runs)
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    return told(text)


def held_out(id_col: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    labelled = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return fit(training_sample(labelled))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, runs`` of every row."""
    model = fit_documents(docs, id_col, text_col, lang_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), model, docs.sparkSession, runs=True).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.runs"
    )


def keep_known(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows with letters whose words are told with at least ``least`` on average, in one language or several, with all their columns.

    Without a model, that is if no training row has a label, every row with letters is kept.
    """
    model = fit_documents(docs, id_col, text_col, lang_col)
    text = F.col(f"`{text_col}`")
    if model is None:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    told = docs.withColumn("__em_p", predict(text, model, docs.sparkSession))
    return told.where((F.col("__em_p.lang") != UND) & (F.col("__em_p.sure") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
