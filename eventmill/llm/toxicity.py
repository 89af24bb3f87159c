"""Toxicity severity by cumulative-link ordinal regression on sparse words.

Features are the distinct words of a text and their beginnings of 4 to 6 letters, which
catch inflected and compound forms. Weights are not negative: clean text around it never
hides toxic text. The grades 0 to 3 share one weight for each word; three ordered thresholds tell them
apart: P(grade > k) = sigmoid(score - threshold[k]). The output is the expected severity.

Labels say toxic or not. Grades 1 to 3 are therefore made from the toxic sample: the thirds
of the summed log-odds of a document's words for the toxic class. The model is fitted on
a bounded sample of labelled rows: about ``SAMPLE`` of each class by a hash of the id over
all labels. Words in fewer than ``LEAST`` sampled documents, and weights that the L1 penalty
leaves at zero, are no features. Prediction reads whole texts.

Defined results: a text that is null or has no word has the severity of an empty feature
set; without labels every document has severity 0; repeated rows and null ids are scored each for itself;
texts of any length are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.llm.bpe import Remembered
from eventmill.llm.texts import pieces

SAMPLE, LEAST, GRADES = 1500, 8, 3
EPOCHS, RATE, L1, DECISION = 300, 0.05, 1e-4, 0.3

_WORD = re.compile(r"\w+")
_EDGE = re.compile(r"\W")


def words(text: str | None) -> set[str]:
    """The distinct words of the whole text, in lower case; a long text is lower-cased whole and then read in pieces."""
    text = (text or "").lower()
    out: set[str] = set()
    for a, b in pieces(text, _EDGE):
        out.update(_WORD.findall(text, a, b))
    return out


def features(word: str) -> list[str]:
    return [word, *(f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


@dataclass
class Severity:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * GRADES)

    def __post_init__(self):
        get = self.weights.get
        self._of = Remembered(lambda w: sum(get(f, 0.0) for f in features(w)))

    def __reduce__(self):
        return Severity, (self.weights, self.thresholds)

    def above(self, text: str | None) -> list[float]:
        """P(grade > 0), P(grade > 1), P(grade > 2)."""
        score = math.fsum(map(self._of.__getitem__, words(text))) if self.weights else 0.0
        self._of.trim()
        return [0.0 if t == math.inf else 1.0 / (1.0 + math.exp(min(500.0, max(-500.0, t - score)))) for t in self.thresholds]


class Bags:
    """Documents as arrays of feature numbers; each feature's text is held once."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[tuple[int, int, np.ndarray]] = []  # id, toxic, features

    def add(self, doc_id: int, toxic: int, found: Iterable[str]) -> None:
        number = self.index.setdefault
        flat = [number(f, len(self.index)) for w in found for f in features(w)]
        self.rows.append((doc_id, toxic, np.sort(np.array(flat, np.int32))))


def grades(bags: list[np.ndarray], toxic: np.ndarray, seen: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """0 for clean documents; 1 to 3 by thirds of the toxic ones' log-odds mass."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((bad + 0.5) / (n1 + 1) / ((seen - bad + 0.5) / (n0 + 1)))
    odds[(bad < LEAST) | (odds <= 2.0)] = 0.0
    mass = np.array([odds[b].sum() for b in bags])
    out = np.zeros(len(bags), int)
    if toxic.any():
        cuts = np.quantile(mass[toxic == 1], [1 / 3, 2 / 3])
        out[toxic == 1] = 1 + np.searchsorted(cuts, mass[toxic == 1], side="left")
    return out


def fit(sample: Bags) -> Severity:
    """Proportional odds with an L1 penalty and weights of 0 or more, by projected Adam steps.

    Features are those in ``LEAST`` documents that are more frequent in toxic ones.
    """
    ordered = sorted(sample.rows, key=lambda r: (r[0], r[1], len(r[2])))
    y1 = np.array([y for _, y, _ in ordered], int)
    if not len(y1) or y1.min() == y1.max():
        return Severity()
    bags = [b for _, _, b in ordered]
    seen, bad = np.zeros(len(sample.index)), np.zeros(len(sample.index))
    for b, t in zip(bags, y1):
        once = np.unique(b)
        seen[once] += 1
        bad[once] += t
    y = grades(bags, y1, seen, bad)
    share = y1.mean()
    good = (seen >= LEAST) & (bad > (share + 0.5 * (1 - share)) * seen)
    names = sorted(f for f, k in sample.index.items() if good[k])
    at = np.full(len(sample.index), -1)
    at[[sample.index[f] for f in names]] = np.arange(len(names))
    rows = [np.sort(at[b][at[b] >= 0]) for b in bags]
    flat = np.concatenate(rows)
    n = len(y)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    each, m = np.arange(n), len(names)
    x = np.concatenate([np.zeros(m), np.arange(GRADES, dtype=float)])  # weights, then thresholds
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, EPOCHS + 1):
        w, base = x[:m], x[m:]
        score = np.bincount(doc, w[flat], n)
        up = np.concatenate([np.ones((1, n)), 1 / (1 + np.exp(np.clip(base[:, None] - score, -60, 60))), np.zeros((1, n))])
        p = np.maximum(up[y, each] - up[y + 1, each], 1e-9)
        slope = up * (1 - up)
        d_score = (slope[y, each] - slope[y + 1, each]) / p
        g = np.empty_like(x)
        g[:m] = np.bincount(flat, d_score[doc], m) / n - L1
        for k in range(1, GRADES + 1):
            g[m + k - 1] = ((slope[k] / p)[y == k - 1].sum() - (slope[k] / p)[y == k].sum()) / n
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        x[:m] = np.maximum(x[:m], 0)
        x[m:] = np.sort(x[m:])
    return Severity({names[k]: float(x[k]) for k in np.flatnonzero(x[:m] > 0.02)}, [float(b) for b in x[m:]])


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Severity:
    """``labels(doc_id, toxic)``; the sample's ids are bounded by ``3 * sample`` and broadcast."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Severity()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(v) for y, c in sorted(n.items()) for v in (y, min(1.0, sample / c))])
    ids = known.where(draw < share[F.col("toxic")]).limit(3 * sample)

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(words(t)) for t in texts], dtype=object)

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample_rows = Bags()
    for r in text.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", parts("text").alias("w")).toLocalIterator():
        sample_rows.add(r.doc_id, r.toxic, r.w)
    return fit(sample_rows)


def predict(text: Column, model: Severity, spark) -> Column:
    """Struct(severity, grade, p_toxic) of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                up = model.above(t)
                each = [a - b for a, b in zip([1.0, *up], [*up, 0.0])]
                rows.append((math.fsum(up), int(np.argmax(each)), up[0]))
            yield pd.DataFrame(rows, columns=["severity", "grade", "p_toxic"])

    return told(text)


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic`` of every row."""
    model = fit_documents(docs, labels, id_col, text_col)
    told = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col), model, docs.sparkSession).alias("p"))
    return told.select("doc_id", "p.*", (F.col("p.p_toxic") >= DECISION).alias("toxic"))
